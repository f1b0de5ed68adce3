import pytest
from pyspark.sql import functions as F

from panelkit.operators import panel, report


def cells_of(spark, columns):
    rows = [(i, name, v) for name, values in columns.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, feature string, value double")


def test_gates_at_their_edges(spark):
    n = 10_000
    columns = {
        "m1allnull": [None] * n,
        "m1constant": [2.0] * n,
        "m1at99": [1.0] * 50 + [2.0] * 50 + [None] * (n - 100),
        "m1over99": [1.0] * 49 + [2.0] * 50 + [None] * (n - 99),
        "m1forty": [0.0] * 40 + [1.0] * 9960,
        "m1thirtynine": [0.0] * 39 + [1.0] * 9961,
        "m1between": [1.0] * 5000 + [2.0] * 5000,
    }
    split = {r.feature: r for r in panel.median_split(cells_of(spark, columns), n_rows=n).collect()}
    assert "m1allnull" not in split
    assert not split["m1constant"].balanced
    assert split["m1at99"].dense and not split["m1over99"].dense
    assert split["m1between"].median == 1.5
    assert (split["m1forty"].zeros, split["m1forty"].balanced) == (40, True)
    assert (split["m1thirtynine"].zeros, split["m1thirtynine"].balanced) == (39, False)
    kept = panel.binarize_cells(cells_of(spark, columns), panel.median_split(cells_of(spark, columns), n_rows=n))
    assert {r.feature for r in kept.select("feature").distinct().collect()} == {"m1at99", "m1forty", "m1between"}


def test_profile_small_counts_and_text(spark):
    df = spark.createDataFrame(
        [("a1", 1.0, None), ("a1", -3.0, None), ("b1", None, "x"), ("b1", None, "y"), ("b1", None, "Missing"), ("c1", 2.0, None), ("c1", 4.0, None)],
        "feature string, value double, text string",
    )
    got = {r.feature: (r.n_valid, r.n_unique, r.std) for r in panel.column_profile(df, "text").collect()}
    assert got == {"a1": (1, 0, None), "b1": (2, 2, None), "c1": (2, 2, 1.0)}


def chunks_by_loop(features, size, tail):
    import re

    stems: dict = {}
    for f in sorted(features, key=lambda f: (re.search(r"\d", f).group(), f)):
        wave = re.search(r"\d", f).group()
        stems.setdefault(f.replace(wave, "", 1), []).append((wave, f))
    sets: dict = {}
    for stem, cols in stems.items():
        if len(cols) > 1:
            sets.setdefault("".join(sorted({w for w, _ in cols})), []).append(stem)
    out, count = [], 0
    for number, comb in enumerate(sorted(sets, key=int)):
        members = sorted(sets[comb])
        for wave in comb:
            for piece, start in enumerate(range(0, len(members) - (tail - 1), size)):
                chunk = [f for s in members[start : start + size] for w, f in stems[s] if w == wave]
                out.append((wave, int(comb), count, number, piece, chunk))
                count += 1
    return out


def test_feature_chunks_match_loop(spark):
    features = [f"q{w}s{i:03d}" for i in range(120) for w in ("123" if i % 3 else "13" if i % 2 else "2")]
    features += ["a1b", "ab1", "ab2", "nodigit", "z7x", "z8x"]
    got = panel.feature_chunks(spark.createDataFrame([(f,) for f in features], "feature string"), 7, 4)
    rows = sorted((r.chunk_index, r.year, r.comb, r.chunk_index_without_year, r.piece, r.chunk) for r in got.collect())
    used = [f for f in features if any(c in "12345" for c in f)]
    want = sorted((i, w, c, n, p, ch) for w, c, i, n, p, ch in chunks_by_loop(used, 7, 4))
    assert rows == want


@pytest.mark.parametrize("n", [0, 1, 30, 31, 60, 61, 90, 91, 121, 400])
def test_tail_rule(n):
    kept = {p // 60 for p in range(n) if p // 60 * 60 < n - 30}
    assert kept == set(range(len(range(0, n - 30, 60))))


def test_two_columns_of_one_stem_and_wave(spark):
    g = panel.stem_groups(spark.createDataFrame([("a1b",), ("ab1",), ("ab2",)], "feature string")).collect()
    assert [(r.stem, r["columns"], r.waves, r.n_columns) for r in g] == [("ab", ["a1b", "ab1", "ab2"], ["1", "2"], 3)]


def test_select_available_gate(spark):
    chunks = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["x", "y", "a"])], "chunk_index long, chunk array<string>")
    have = spark.createDataFrame([("a",), ("c",)], "feature string")
    got = panel.select_available(chunks, have, max_missing=1).collect()
    assert [(r.chunk_index, r.chunk, r.n_missing) for r in got] == [(0, ["a", "c"], 1)]
    assert panel.select_available(chunks, have, max_missing=None).count() == 2


def test_wave_order_is_stable():
    assert panel.wave_order(["b2", "id", "a1", "c2", "a2"]) == ["a1", "b2", "c2", "a2", "id"]


def test_grid_refuses_double_cells(spark):
    df = spark.createDataFrame([("t", 1, 0, 0.1), ("t", 1, 0, 0.2)], "task string, year int, chunk_index_without_year int, gain double")
    with pytest.raises(Exception, match="more than one score"):
        report.score_grid(df, [0, 1]).collect()
    ok = report.score_grid(df.limit(1), [0, 1]).first()
    assert ok["1"] is None and ok["0"] in (0.1, 0.2)


def test_melt_keeps_nulls_and_text(spark):
    df = spark.createDataFrame([(1, 2, None), (2, None, "x")], "k long, a int, b string")
    got = {(r.k, r.feature): (r.value, r.text) for r in panel.melt(df, "k").collect()}
    assert got == {(1, "a"): (2.0, None), (1, "b"): (None, None), (2, "a"): (None, None), (2, "b"): (None, "x")}
    assert panel.melt(df, "k").where(F.col("value") >= 0).count() == 1


def test_column_kinds(spark):
    rows = [(i, float(i), None if i % 2 else "a", -1.0, 5.0) for i in range(100)]
    cells = panel.melt(spark.createDataFrame(rows, "id long, n double, t string, gone double, same double"), "id")
    got = panel.column_kinds(cells, panel.median_split(cells)).first()
    assert (got.text_columns, got.usable_columns, got.n_columns) == (1, 1, 4)
