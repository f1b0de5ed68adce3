"""Cases the test tables lack: long numbers, large ids, unlisted cells, null rows, marked gaps."""

import pytest
from pyspark.sql import functions as F

from panelkit.functions import text as tx
from panelkit.operators import joins, panel, report, sampling, textrows
from panelkit.sources import files


def test_number_text(spark):
    values = [1.5e7, 1e-4, 0.00012345, 1e16, 1e-5, 3.0, -2.5, 0.0, float("inf"), 123456789.125, 1.5e-7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(tx.float_text(F.col("v")).alias("t")).collect()] == [repr(v) for v in values]


def test_long_number(spark):
    row = spark.range(1).select(tx.number_after(F.lit("aged " + "1" * 25), "aged").alias("n")).first()
    assert row.n == float("1" * 25)


@pytest.mark.parametrize("text", [False, True])
def test_split_of_large_and_text_ids(spark, text):
    ids = spark.createDataFrame([(2**60 + i,) for i in range(10)], "id long")
    ids = ids.select(F.concat(F.lit("k"), F.col("id")).alias("id")) if text else ids
    sides = {r["split"]: r["count"] for r in sampling.ordered_split(ids, "id", 0.5).groupBy("split").count().collect()}
    assert sides == {"train": 5, "eval": 5}


def test_rows_without_values(spark):
    cells = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", None)], "id int, feature string, value double")
    got = lambda s: {r.id: r.text for r in textrows.render_rows(cells, "id", ["a", "b"], s).collect()}
    assert got("raw") == {1: "a 1.0 , b nan , ", 2: "a nan , b nan , "}
    assert got("token") == {1: "a_1 b_# ", 2: "a_# b_# "}


def test_unlisted_values_are_errors(spark):
    preds = spark.createDataFrame([(1, "t", 67, 0.5)], "id int, task string, chunk_index int, predicted_diff double")
    with pytest.raises(Exception, match="outside the given list: 67"):
        report.pivot_chunk_predictions(preds).collect()
    scores = spark.createDataFrame([("nobody", 0.5)], "task string, R double")
    with pytest.raises(Exception, match="no baseline for task nobody"):
        report.subtract_baseline(scores).collect()


def test_number_rule(spark):
    cells = spark.createDataFrame([(1, "a", "1_0"), (2, "a", "2"), (1, "b", "x")], "id int, feature string, text string")
    assert sorted(r.value for r in panel.drop_text_columns(cells).collect()) == [2.0, 10.0]


def test_marked_numbers_are_numbers(spark, tmp_path):
    path = str(tmp_path / "marks")
    rows = [("3", "NA", "x"), ("NA", "1.5", "y"), ("4", "2.5", "NA")]
    spark.createDataFrame(rows, "a string, b string, t string").coalesce(1).write.option("header", True).csv(path)
    table = files.read_table(spark, path)
    assert dict(table.dtypes) == {"a": "double", "b": "double", "t": "string"}
    assert {tuple(r) for r in table.collect()} == {(3.0, None, "x"), (None, 1.5, "y"), (4.0, 2.5, None)}


def test_wide_numbers_are_not_broadcast(spark):
    wide = spark.range(100).select(*[F.col("id").cast("double").alias(f"c{i}") for i in range(50)])
    assert joins.is_small(wide) and not joins.is_small(wide, max_bytes=10_000)
