"""Row numbers, running totals, quantiles and joins, with one key that holds a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import joins, ordering, quantiles


def hot_rows(n=3000, seed=3):
    """(id, group, value): group 0 holds a third of all rows."""
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 1 / 3 else rng.randrange(1, 40), rng.choice([round(rng.gauss(0, 9), 3), 1.0, 2.0])) for i in range(n)]


SCHEMA = "id long, g long, v double"


@pytest.fixture(scope="module")
def hot(spark):
    rows = hot_rows()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(7).cache()


def test_number_shuffled_is_a_permutation(hot):
    _, df = hot
    first = {r.id: r.row_no for r in ordering.number_shuffled(df, ["id"], 1).collect()}
    again = {r.id: r.row_no for r in ordering.number_shuffled(df.repartition(3), ["id"], 1).collect()}
    other = {r.id: r.row_no for r in ordering.number_shuffled(df, ["id"], 2).collect()}
    assert sorted(first.values()) == list(range(1, 3001)) and first == again != other


def test_number_ordered_whole_table(hot):
    rows, df = hot
    got = {r.id: (r.row_no, r.upto) for r in ordering.number_ordered(df, ["v", "id"], totals={"upto": "id"}).collect()}
    total = 0
    for no, (i, _, v) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1):
        total += i
        assert got[i] == (no, total)


def test_number_ordered_within_groups(hot):
    rows, df = hot
    numbered = ordering.number_ordered(df, ["id"], within=["g"], totals={"upto": "v"})
    got = {r.id: (r.row_no, r.upto) for r in numbered.collect()}
    seen: dict = {}
    for i, g, v in sorted(rows):
        n, s = seen.get(g, (0, 0.0))
        seen[g] = (n + 1, s + v)
        assert got[i][0] == n + 1 and got[i][1] == pytest.approx(s + v)


def test_hot_group_is_cut_into_pieces(hot):
    _, df = hot
    pieces = ordering.in_pieces(df, ["g", "id"]).where("g = 0")
    assert pieces.select("_piece").distinct().count() > 1


def test_renumber(spark, monkeypatch):
    monkeypatch.setattr(ordering, "PIECE_ROWS", 10)
    kept = sorted(random.Random(5).sample(range(500), 120))
    df = spark.createDataFrame([(k,) for k in kept], "p long").repartition(5)
    got = {r.p: r.no for r in ordering.renumber(df, "p", "no", 500).collect()}
    assert got == {p: i + 1 for i, p in enumerate(kept)}


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_match_numpy(hot, accuracy):
    rows, df = hot
    shares = {"a": 0.25, "b": 0.5, "c": 0.9}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", shares, accuracy).collect()}
    for g in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == g]
        assert got[g].n == len(values)
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile(values, share), abs=1e-12)
    whole = quantiles.exact_quantiles(df, [], "v", shares, accuracy).first()
    for name, share in shares.items():
        assert whole[name] == pytest.approx(np.quantile([r[2] for r in rows], share), abs=1e-12)


def test_brackets_keep_few_values(hot):
    rows, df = hot
    steps = quantiles.rank_steps(df, [], "v", [0.5], accuracy=200)
    assert steps.count() < len({r[2] for r in rows}) / 4
    assert steps.agg(F.sum("n")).first()[0] == len(rows)


def test_quantiles_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 3.0), (1, 4.0), (2, None)], "g long, v double")
    got = quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()
    assert [(r.g, r.n, r.m) for r in got] == [(1, 2, 3.5)]


def test_hot_keys(hot):
    _, df = hot
    key = df.sparkSession.range(1).select(F.xxhash64(F.lit(0).cast("long"))).first()[0]
    assert joins.hot_keys(df, ["g"], 500) == [key]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("path", ["broadcast", "shuffle", "hot"])
def test_lookup_join_paths_agree(spark, hot, how, path):
    rows, df = hot
    one = spark.createDataFrame([(g, f"n{g}") for g in range(0, 40, 2)], "g long, name string")
    options = {
        "broadcast": {},
        "shuffle": {"max_rows": 0, "hot_rows": 10**9},
        "hot": {"max_rows": 0, "hot_rows": 500, "salts": 4},
    }[path]
    joined = joins.lookup_join(df, one, ["g"], how, **options)
    plan = joined._jdf.queryExecution().toString()
    assert ("_salt" in plan) == (path == "hot")
    got = sorted(tuple(r) for r in joined.select("id", *(["name"] if how in ("inner", "left") else [])).collect())
    want = []
    for i, g, _ in rows:
        hit = g % 2 == 0
        if how == "inner" and hit:
            want.append((i, f"n{g}"))
        elif how == "left":
            want.append((i, f"n{g}" if hit else None))
        elif how == "left_semi" and hit or how == "left_anti" and not hit:
            want.append((i,))
    assert got == sorted(want, key=lambda r: tuple(str(x) if x is None else x for x in r)) or sorted(map(str, got)) == sorted(map(str, want))


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from panelkit.sources import staging

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        staging.staging_root(Session())


def test_fan_out_packs_blocks(spark):
    from panelkit.operators.joins import fan_out

    # One key with very many entries, equal ones among them, small keys and a key without rows.
    few = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") % 20_000).alias("v")).unionByName(
        spark.createDataFrame([(2, 5), (2, 6), (3, 7), (9, 1)], "k int, v long")
    ).repartition(5)
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (None, "f")], "k int, r string")
    for block in (1000, 40_000):
        got = fan_out(rows, few, ["k"], block=block)
        counts = {r.r: (r.n, r.total) for r in got.groupBy("r").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}
        total = sum(i % 20_000 for i in range(30_000))
        assert got.columns == ["k", "r", "v"]
        assert counts == {"a": (30_000, total), "b": (30_000, total), "c": (2, 11), "d": (1, 7)}


def test_large_joins_are_dealt_by_their_rows(spark, monkeypatch):
    """A task of a large join gets a bounded number of rows, whatever adaptive execution would pack."""
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    many = spark.range(4000).select((F.col("id") % 2000).alias("k"), "id")
    one = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for spread in (False, True):
        joined = joins.lookup_join(many, one, ["k"], spread=spread, max_rows=10)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 40 and max(r["count"] for r in sizes) < 400
        assert joined.where("v = 2 * k").count() == 4000


def test_wave_cells_meet_by_id(spark, tmp_path, monkeypatch):
    """Cells are dealt by id over tasks of bounded rows; a group by id shuffles nothing more."""
    from panelkit.queries import tables

    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    spark.range(3000).selectExpr("id div 3 AS l_orderkey", "id % 3 AS l_linenumber", "5D AS l_quantity", "1D AS l_extendedprice", "0D AS l_discount", "0D AS l_tax").write.parquet(str(tmp_path / "lineitem.parquet"))
    ids = tables.cells(spark, str(tmp_path)).groupBy("id").agg(F.count("*").alias("n"))
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert ids.agg(F.count("*"), F.sum("n")).first() == (1000, 3000)
