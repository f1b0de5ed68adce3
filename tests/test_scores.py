"""Scores, models, labels and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import evaluate, imputation, labels, models, trees
from panelkit.sources import files
from panelkit.sources.staging import stage


def r2(p, g, m):
    p, g = np.asarray(p, float), np.asarray(g, float)
    return 1 - ((p - g) ** 2).sum() / ((np.mean(m) - g) ** 2).sum()


def test_holdout_r2(spark):
    rng = np.random.default_rng(1)
    rows = []
    for task in ("a", "b"):
        for _ in range(200):
            g = float(rng.normal(5, 2))
            rows.append((task, float(g + rng.normal()), g if rng.random() < 0.8 else None, float(rng.normal(4, 0.1))))
    df = spark.createDataFrame(rows, "task string, prediction double, truth double, ybar_train double")
    for r in evaluate.r2_by(df, ["task"]).collect():
        kept = [x for x in rows if x[0] == r.task and x[2] is not None]
        assert r.R == pytest.approx(r2([x[1] for x in kept], [x[2] for x in kept], [x[3] for x in kept]))
    known = df.where("truth is not null")
    assert known.agg(evaluate.holdout_r2("truth", "truth", F.lit(1.0)).alias("R")).first()[0] == 1.0
    at_mean = known.withColumn("m", F.lit(3.0)).agg(evaluate.holdout_r2("m", "truth", "m").alias("R")).first()[0]
    assert at_mean == pytest.approx(0.0, abs=1e-12)
    broken = known.limit(5).unionByName(known.limit(1).withColumn("prediction", F.lit(None).cast("double")))
    assert broken.agg(evaluate.holdout_r2("prediction", "truth", "ybar_train").alias("R")).first()[0] is None


def test_r2_from_train_without_keys(spark):
    test = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "p double, g double")
    train = spark.createDataFrame([(1.0,), (2.0,)], "y double")
    got = evaluate.r2_from_train(test, train, [], "p", "g", "y").first()[0]
    assert got == pytest.approx(r2([1, 3], [2, 5], [1.5]))


def test_ensembles_and_best_pick(spark):
    rows = [(0 if i % 3 == 0 else i % 5, i, float((i * 37) % 101), 50.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, r long, s double, target double")
    for r in evaluate.mean_and_median_per_id(df, ["id"], "s").collect():
        v = [x[2] for x in rows if x[0] == r.id]
        assert (r.mean_diff, r.median_diff, r.n_rows) == (pytest.approx(np.mean(v)), pytest.approx(np.median(v)), len(v))
    for r in evaluate.best_pick(df, ["id"], "s", "target", "r").collect():
        v = [x[2] for x in rows if x[0] == r.id]
        assert r.best == v[int(np.abs(np.array(v) - 50).argmin())]


def test_accuracy_takes_first_of_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5], 0), ([0.1, 0.9], 0)], "l array<double>, y int")
    assert df.agg(evaluate.accuracy("l", "y")).first()[0] == 0.5


def test_ols_collinear_and_id(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    ind = rng.integers(0, 3, size=200)
    one_hot = np.eye(3)[ind]
    y = 1 + x @ [2.0, -1.0] + one_hot @ [0.5, 1.0, 2.0] + rng.normal(size=200) / 10
    full = np.hstack([x, one_hot])
    cols = ["x0", "x1", "h0", "h1", "h2"]
    df = spark.createDataFrame(
        [(i, *map(float, full[i]), float(y[i])) for i in range(200)], "id long, " + ", ".join(f"{c} double" for c in cols) + ", y double"
    )
    model = models.ols(df, cols, "y", "id")
    design = np.hstack([np.ones((200, 1)), full])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = np.array([r.prediction for r in models.predict(model, df, cols).orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-6)
    assert models.ols_score(model) == pytest.approx(r2(want, y, y), abs=1e-6)
    assert len(models.ols(df, cols, "y", "id", include_id=True).coefficients) == 6


def test_pmm_takes_nearest_donor(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = [None if rng.random() < 0.3 else float(3 * v + rng.normal()) for v in x]
    rows = [(i, float(x[i]), y[i]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    got = {r.id: r.y for r in imputation.impute_pmm(df, "id", "y", ["x"]).collect()}
    known = [(v, t) for _, v, t in rows if t is not None]
    a = np.polyfit([v for v, _ in known], [t for _, t in known], 1)
    for i, v, t in rows:
        if t is not None:
            assert got[i] == t
            continue
        gaps = np.abs(np.polyval(a, [k for k, _ in known]) - np.polyval(a, v))
        assert got[i] in {known[j][1] for j in np.flatnonzero(gaps <= gaps.min() + 1e-9)}


def test_chained_imputation(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x = float(rng.normal())
        g = float(x > 0) if rng.random() < 0.8 else None
        y = float(2 * x + rng.normal() / 10) if rng.random() < 0.8 else None
        z = float(x - 1) if rng.random() < 0.9 else None
        rows.append((i, x, y, g, z))
    df = spark.createDataFrame(rows, "id long, x double, y double, g double, z double")
    how = {"y": "least squares", "g": "multinomial logistic", "z": "pmm"}
    out = imputation.impute_chained(df, "id", how, ["x"], copies=2, rounds=2, seed=1).toPandas()
    assert len(out) == 600 and not out.isna().any().any() and set(out.g) == {0.0, 1.0}
    for i, x, y, g, z in rows:
        mine = out[out.id == i]
        for name, value in (("y", y), ("g", g), ("z", z)):
            if value is not None:
                assert set(mine[name]) == {value}
    gaps = [r[0] for r in rows if r[2] is None]
    a, b = (out[(out.copy_no == c) & out.id.isin(gaps)].sort_values("id") for c in (1, 2))
    assert (a.y.to_numpy() != b.y.to_numpy()).all()
    assert np.corrcoef(a.x, a.y)[0, 1] > 0.95


def test_chained_imputation_of_odd_columns(spark):
    how = {"y": "least squares"}
    empty = spark.createDataFrame([(1, 1.0, None)], "id long, x double, y double")
    with pytest.raises(ValueError, match="y has no known value"):
        imputation.impute_chained(empty, "id", how, ["x"])
    hole = spark.createDataFrame([(1, 1.0, 2.0), (2, None, None)], "id long, x double, y double")
    with pytest.raises(Exception, match="x is null"):
        imputation.impute_chained(hole, "id", how, ["x"]).collect()
    # Two equal predictors, a constant one and a class of one code.
    rows = [(i, float(i), float(i), 5.0, 3.0 * i if i % 3 else None, 0.0 if i % 4 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double, g double")
    out = imputation.impute_chained(df, "id", {**how, "g": "multinomial logistic"}, ["a", "b", "c"], copies=2, rounds=1).toPandas()
    assert np.allclose(out.y, 3 * out.id, atol=1e-6) and set(out.g) == {0.0} and len(out) == 118


def test_classifier_solves_its_equations(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2)) * [3, 0.1] + [100, -5]
    code = (x[:, 0] - 100 + rng.normal(size=600) * 2 > 0).astype(int) + (rng.random(600) < 0.2)
    rows = [(i % 2 + 1, *map(float, x[i]), float(code[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "copy_no int, a double, b double, g double").repartition(5)
    plain, _ = imputation._classifier(df, "copy_no", "g", ["a", "b"], 3)
    mean, spread = x.mean(0), x.std(0)
    for copy in (1, 2):
        mine = np.arange(600) % 2 + 1 == copy
        z = np.column_stack([np.ones(mine.sum()), (x[mine] - mean) / spread])
        w = np.array(plain[copy])
        scaled = np.column_stack([w[:, 0] + w[:, 1:] @ mean, w[:, 1:] * spread])
        p = np.exp(np.column_stack([np.zeros(len(z)), z @ scaled.T]))
        p /= p.sum(axis=1, keepdims=True)
        hit = code[mine][:, None] == np.arange(3)
        slope = (hit - p)[:, 1:].T @ z - imputation.PENALTY * len(z) * scaled
        assert np.abs(slope).max() < 1e-4


def test_each_row_meets_its_model(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "u").alias("task"), (F.col("id") % 4).alias("chunk")).repartition(6)

    def load(task, chunk):
        shift = (1000 if task == "u" else 0) + chunk
        return lambda batch: batch["id"] * 2 + shift

    out = models.score_by_model(df, ["task", "chunk"], ["id"], load)
    rows = out.collect()
    assert len(rows) == 3000 and all(r.score == r.id * 2 + (1000 if r.id % 3 else 0) + r.id % 4 for r in rows)
    assert out.where("false").count() == 0


def test_scoring_sends_back_only_what_is_kept(spark):
    df = spark.createDataFrame([(i, "u" if i % 2 else None, "x" * i) for i in range(50)], "id long, task string, text string")
    out = models.score_by_model(df, ["task"], ["id"], lambda task: lambda batch: batch["text"].str.len(), keep=["id", "task"])
    assert out.columns == ["id", "task", "score"]
    assert sorted((r.id, r.task, r.score) for r in out.collect()) == [(i, "u" if i % 2 else None, float(i)) for i in range(50)]


def test_trees_of_two_tasks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 2))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] * 0.1
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(400)], "id long, a double, b double, diff double")
    # The second task has the opposite residual; one tree for both would find nothing.
    tasks = F.explode(F.array(F.struct(F.lit("t").alias("task"), F.col("diff")), F.struct(F.lit("u").alias("task"), (-F.col("diff")).alias("diff"))))
    cells = df.select("id", "a", "b", tasks.alias("t")).select(F.lit(0).alias("chunk_index"), "id", "t.task", "t.diff", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("a", "b")])))
    out = models.tree_per_chunk(cells, {0: ["a", "b"]}, F.col("id") < 300).orderBy("task").collect()
    assert [(r.task, r.n_test) for r in out] == [("t", 100), ("u", 100)] and max(r.mae for r in out) < 0.2


def brute_tree(rows, depth, node=1):
    """Nodes of a tree by trying every split: {node: (n, mean, feature, bin)}."""
    n, s = len(rows), sum(y for _, y in rows)
    best = None
    if depth and len({y for _, y in rows}) > 1:
        for f in range(len(rows[0][0])):
            for b in sorted({r[0][f] for r in rows})[:-1]:
                left = [y for bins, y in rows if bins[f] <= b]
                gain = sum(left) * sum(left) / len(left) + (s - sum(left)) * (s - sum(left)) / (n - len(left))
                if best is None or gain > best[0]:
                    best = (gain, f, b)
    out = {node: (n, s / n, *(best[1:] if best else (None, None)))}
    if best:
        for side in (0, 1):
            out |= brute_tree([r for r in rows if (r[0][best[1]] > best[2]) == bool(side)], depth - 1, 2 * node + side)
    return out


def test_grown_trees_against_every_split(spark):
    rng = np.random.default_rng(7)
    data = {m: [([int(v) for v in rng.integers(0, 4, 3)], int(rng.integers(-9, 10))) for _ in range(60)] for m in "ab"}
    data["c"] = [([1, 1, 1], 5)] * 4
    rows = [(m, i, True, bins, y, 1) for m, own in data.items() for i, (bins, y) in enumerate(own)]
    rows += [("a", 99, False, [0, 0, 0], 0, 1), ("z", 99, False, [0, 0, 0], 0, 1)]
    df = spark.createDataFrame(rows, "m string, id long, train boolean, bins array<int>, y long, w long")
    for depth in (0, 2, 30):
        grown = trees.grow(df, ["m"], depth)
        got = {(r.m, r.node): (r.n, r.value, r.feature, r.bin) for r in grown.nodes.collect()}
        assert got == {(m, k): v for m, own in data.items() for k, v in brute_tree(own, depth).items()}
        leaves = grown.leaves.collect()
        assert len(leaves) == len(rows) - 1 and all(r.value is not None for r in leaves)


def test_boosting_of_all_tasks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 2))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] * 0.1
    rows = [(i, task, *map(float, x[i]), sign * float(y[i])) for task, sign in (("t", 1), ("u", -1)) for i in range(400)]
    rows += [(i, "same", *map(float, x[i]), 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, task string, a double, b double, diff double")
    model, out = models.boosted_correction(df, df.unionByName(df.limit(1).withColumn("task", F.lit("none"))), ["a", "b"], rounds=4, rate=0.5)
    got = {r.task: r for r in out.groupBy("task").agg(F.avg(F.abs(F.col("diff") - F.col("predicted_diff"))).alias("gap"), F.count("predicted_diff").alias("n")).collect()}
    assert got["t"].gap < 0.15 and got["u"].gap < 0.15 and got["same"].gap == 0 and got["none"].n == 0
    assert [sorted(w) for w in model.weights][0] == [("same",), ("t",), ("u",)] and len(model.weights) == 4
    # The weighted median against its definition.
    edges = np.array([[r[2], r[3]] for r in rows])
    bins = [[int((np.array(e) < v).sum()) for v, e in zip(edges[0], (sorted(set(np.sort(edges[:, j])[[-(-k * len(rows) // 32) - 1 for k in range(1, 32)]])) for j in (0, 1)))]]
    votes = []
    for found, own in zip(model.trees, model.weights):
        nodes, node = {r.node: r for r in found if r.task == "t"}, 1
        while node in nodes and nodes[node].feature is not None:
            r = nodes[node]
            right = bins[0][r.feature] > r.bin
            node, value = 2 * node + right, r.right if right else r.left
        votes.append((nodes[node].value if node in nodes else value, own[("t",)]))
    votes.sort()
    upto, half = 0.0, sum(w for _, w in votes) / 2
    want = next(p for p, w in votes if (upto := upto + w) >= half)
    assert out.where("id = 0 and task = 't'").first().predicted_diff == pytest.approx(want / trees.SCALE)
    with pytest.raises(Exception, match="a is null"):
        models.boosted_correction(df.withColumn("a", F.when(F.col("id") > 0, F.col("a"))), df, ["a", "b"], rounds=1)


def test_score_batches_loads_once_per_task(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<double>").repartition(3)
    out = models.score_batches(df, models.linear_scorer("v", [2.0, 3.0], 1.0))
    assert out.columns == ["id", "v", "score"] and df.columns == ["id", "v"]
    assert {r.id: r.score for r in out.collect()} == {i: 2.0 * i + 4 for i in range(50)}


def test_labels(spark):
    lab = spark.createDataFrame([(1, "layoff", 1.0), (1, "gpa", 2.5), (2, "gpa", None), (9, "gpa", 1.0)], "id long, task string, y double")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, t string")
    got = sorted((r.id, r.t, r.task, r.y) for r in labels.fan_out_labels(lab, rows, "id", "task", "y").collect())
    assert got == [(1, "a", "gpa", 2.5), (1, "a", "layoff", 1.0), (1, "b", "gpa", 2.5), (1, "b", "layoff", 1.0)]
    with pytest.raises(ValueError, match="1 ids have no rows"):
        labels.assert_covered(lab, rows, "id")
    labels.assert_covered(lab.where("id < 9"), rows, "id")


def test_indexed_lines_over_files(spark, tmp_path):
    for name, lines in (("a.txt", ["x", "", "y"]), ("b.txt", ["z"] * 5), ("c.txt", ["last"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = files.read_lines_indexed(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == list(enumerate(["x", "", "y", *["z"] * 5, "last"]))
    assert [r.value for r in files.drop_blank_lines(files.read_lines_indexed(spark, str(tmp_path)), "value").collect()].count("") == 0


def test_split_text_file_keeps_order(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_lines_indexed(spark, str(path))
        assert got.where(F.concat(F.lit("line "), F.col("line_no")) != F.col("value")).count() == 0
        assert got.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_systematic_counts_records_not_lines(spark, tmp_path):
    import csv

    with open(tmp_path / "t.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["family_id", "text"])
        w.writerows([i, f"row {i}\n"] for i in range(250))
    rec = files.read_records_indexed(spark, str(tmp_path / "t.csv"), "family_id long, text string")
    got = sorted(r.family_id for r in files.systematic(rec, "rec_no", 100).collect())
    assert got == [99, 199]


def test_csv_roundtrip(spark, tmp_path):
    rows = [(1, 'a "q", b\nc', 0.5), (2, "", None), (3, None, float("nan")), (4, "NA", 1.0)]
    df = spark.createDataFrame(rows, "i long, t string, v double")
    files.write_csv(df, str(tmp_path / "out"))
    got = files.read_table(spark, str(tmp_path / "out"), df.schema).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, 'a "q", b\nc', 0.5), (2, None, None), (3, None, None), (4, None, 1.0)]
    inferred = files.read_table(spark, str(tmp_path / "out"), na_texts=())
    assert dict(inferred.dtypes)["v"] == "double"
    assert [r.t for r in inferred.where("i = 4").collect()] == ["NA"]


def test_collect_results_strict_and_lenient(spark, tmp_path):
    for task, chunk, value in (("gpa", 0, "0.5\n"), ("gpa", 1, "-0.25")):
        folder = tmp_path / f"{task}_whole_single" / str(chunk)
        folder.mkdir(parents=True)
        (folder / "result.txt").write_text(value)
    pattern = "/([^/]+)_whole_single/([0-9]+)/"
    got = files.collect_results(spark, str(tmp_path), ["task", "chunk_index"], pattern)
    assert sorted(tuple(r) for r in got.collect()) == [("gpa", "0", 0.5), ("gpa", "1", -0.25)]
    grid = spark.createDataFrame([("gpa", i) for i in range(3)], "task string, chunk_index int")
    with pytest.raises(ValueError, match="1 expected results"):
        files.collect_results(spark, str(tmp_path), ["task", "chunk_index"], pattern, grid)
    todo = files.remaining_work(grid, got, ["task", "chunk_index"])
    assert [tuple(r) for r in todo.collect()] == [("gpa", 2)]


def test_small_nodes_are_finished_by_one_task(spark, monkeypatch):
    """Same nodes and leaves however many rows a task may finish; few levels are left for jobs."""
    from panelkit.operators import trees

    rng = np.random.default_rng(5)
    rows = [
        (int(m), int(i), bool(rng.random() < 0.8), [int(b) for b in rng.integers(0, 4, 3)], int(rng.integers(-3, 4)) * 10**12, 1)
        for m in (1, 2) for i in range(150)
    ]
    df = spark.createDataFrame(rows, "m long, id long, train boolean, bins array<int>, y long, w long")
    found, stored = {}, {}
    for most in (0, 10_000):
        monkeypatch.setattr(trees, "LOCAL_ROWS", most)
        names = []
        monkeypatch.setattr(trees, "stage", lambda d, name, keep=names: keep.append(name) or stage(d, name))
        grown = trees.grow(df, ["m"], 4)
        found[most] = tuple(sorted(map(str, t.collect())) for t in (grown.nodes, grown.leaves))
        stored[most] = names.count("splits")
    assert found[0] == found[10_000]
    assert len(found[0][1]) == 300
    assert stored[10_000] == 1 < stored[0]


def test_cells_are_counted_in_batches(spark):
    """Sums are exact beyond 64 bits, also if a batch has to be halved."""
    from panelkit.operators import trees

    rng = np.random.default_rng(6)
    rows = [(str(i % 2), 1 + i % 3, [int(b) for b in rng.integers(0, 3, 2)], int(rng.integers(-(2**45), 2**45)), int(rng.integers(1, 2**34))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, node long, bins array<int>, y long, w long").coalesce(1)
    want = {}
    for k, node, bins, y, w in rows:
        for f, b in enumerate(bins):
            n, ws, s, low, high = want.get((k, node, f, b), (0, 0, 0, y, y))
            want[k, node, f, b] = (n + 1, ws + w, s + w * y, min(low, y), max(high, y))
    got = {(r.k, r.node, r.feature, r.bin): (r.n, int(r.w), int(r.s), r.low, r.high) for r in trees.cells_of(df, ["k"]).collect()}
    assert {c: v[:3] for c, v in got.items()} == {c: v[:3] for c, v in want.items()}
    for (k, node), low, high in {((k, n), min(y for a, m, _, y, _ in rows if (a, m) == (k, n)), max(y for a, m, _, y, _ in rows if (a, m) == (k, n))) for k, n, *_ in rows}:
        own = [v for c, v in got.items() if c[:2] == (k, node)]
        assert min(v[3] for v in own) == low and max(v[4] for v in own) == high


def test_boosters_of_one_task_are_the_shared_ones(spark, monkeypatch):
    """Same trees and weights however many rows a task may fit; a null task has no booster either way."""
    from panelkit.operators import trees

    rng = np.random.default_rng(9)
    rows = [(t, [int(b) for b in rng.integers(0, 5, 3)], int(rng.integers(-(2**40), 2**40))) for t in ("a", "b") for _ in range(120)]
    rows += [("same", [0, 1, 2], 7)] * 4 + [("two", [i % 2, 0, 0], i % 2 * 2**45) for i in range(6)]
    df = spark.createDataFrame(rows, "task string, bins array<int>, y long")
    found = {}
    for most in (0, 10_000):
        monkeypatch.setattr(trees, "LOCAL_BOOST_ROWS", most)
        model = trees.Boosted(["task"], 4, 0.5, 3).fit(df)
        nodes = [sorted((r.task, r.node, r.n, r.value, r.feature, r.bin, r.left, r.right) for r in found) for found in model.trees]
        found[most] = nodes, [{k: round(w, 12) for k, w in own.items()} for own in model.weights]
        votes = model.predict(df, "p").select("task", "bins", F.round("p", 9)).collect()
        found[most] = *found[most], sorted(map(str, votes))
        null = df.withColumn("task", F.when(F.col("task") != "a", F.col("task")))
        assert sorted(trees.Boosted(["task"], 1, 0.5, 3).fit(null).weights[0]) == [("b",), ("same",), ("two",)]
    assert found[0] == found[10_000]
    assert sorted(found[0][1][0]) == [("a",), ("b",), ("same",), ("two",)]


def test_subtrees_hold_few_nodes_at_once(monkeypatch):
    """The same tree however many nodes are counted at once; a node of 400,000 rows is still one task's."""
    from panelkit.operators import trees

    rng = np.random.default_rng(10)
    bins, y = rng.integers(0, 6, (3000, 3)), rng.integers(-(10**6), 10**6, 3000)
    w, train = np.ones(3000, dtype=np.int64), rng.random(3000) < 0.8
    found = []
    for held in (1, 7, 4096):
        monkeypatch.setattr(trees, "HELD_NODES", held)
        nodes, value = trees._subtree(bins, y, w, train, 1, 30)
        found.append(({c: v.tolist() for c, v in nodes.items()}, value.tolist()))
    assert found[0] == found[1] == found[2]
    own = [(tuple(b), int(v)) for b, v, t in zip(bins.tolist(), y, train) if t]
    want = brute_tree(own, 30)
    got = {n: (k, v, *((None, None) if leaf else (f, b))) for n, k, v, f, b, leaf in zip(*found[0][0].values())}
    assert got == want and trees.LOCAL_ROWS >= 400_000
