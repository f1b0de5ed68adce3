"""Inputs the queries share, derived from the test tables, in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import residual
from ..operators.joins import dealt, lookup_join
from ..sources.staging import stage
from .registry import table

# name part before the wave, after it, measure
MEASURES = (
    ("cm", "qty", "q"),
    ("m", "price", "p"),
    ("f", "disc", "d"),
    ("cf", "tax", "t"),
)
WAVES = range(1, 8)
PANEL_FEATURES = [f"{head}{w}{tail}" for w in WAVES for head, tail, _ in MEASURES]

# An order is a family, a line number a wave. The quantity is shifted down
# by three, so that -2 and -1 are sentinel codes and 0 an answer.
CELLS_SQL = """cells AS (
  SELECT l_orderkey AS id, l_linenumber AS w, max(l_quantity) - 3 AS q, max(l_extendedprice) AS p,
         max(l_discount) AS d, max(l_tax) AS t
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
PANEL_SQL = CELLS_SQL + """, panel AS (
  SELECT id, concat('cm', w, 'qty') AS feature, (w - 1) * 4 + 1 AS ord, q AS value FROM cells
  UNION ALL SELECT id, concat('m', w, 'price'), (w - 1) * 4 + 2, p FROM cells
  UNION ALL SELECT id, concat('f', w, 'disc'), (w - 1) * 4 + 3, d FROM cells
  UNION ALL SELECT id, concat('cf', w, 'tax'), (w - 1) * 4 + 4, t FROM cells)"""
# A feature dictionary whose stems exist in different sets of waves.
CATALOG_SQL = """catalog AS (
  SELECT DISTINCT concat('m', 1 + p_size % 5, 'q', p_partkey // 5) AS feature FROM part)"""
# An order is an id, its priority the task; the benchmark predicts the mean
# of the customer; orders in state P have no known outcome. Money is in whole
# cents: sums are then exact, and means the same in every order of adding.
RESIDUAL_SQL = """priced AS (SELECT *, round(o_totalprice * 100) AS cents FROM orders), base AS (
  SELECT o_orderkey AS id, o_orderpriority AS task,
         CASE WHEN o_orderstatus <> 'P' THEN cents END AS truth,
         avg(cents) OVER (PARTITION BY o_custkey) AS prediction,
         avg(cents) OVER (PARTITION BY o_orderpriority) AS ybar_train
  FROM priced), residuals AS (
  SELECT id, task, truth, prediction, ybar_train, truth - prediction AS diff FROM base)"""
# A line is one scored text row of its order; line number and return flag
# make the chunk, the line number is its year, the flag its feature set.
SCORES_SQL = """scores AS (
  SELECT l_orderkey AS id, (l_linenumber - 1) * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
         AS chunk_index, (round(l_tax * 100) - 4) * round(l_extendedprice) AS score
  FROM lineitem)"""
N_SCORE_CHUNKS = 21


def cells(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # The lines of an order meet once; later groups by id shuffle nothing.
    li = dealt(li, li.count(), "l_orderkey")
    return li.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("w")).agg(
        (F.max("l_quantity") - 3).alias("q"),
        F.max("l_extendedprice").alias("p"),
        F.max("l_discount").alias("d"),
        F.max("l_tax").alias("t"),
    )


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Long panel: id, feature, ord, value."""
    parts = [
        F.struct(
            F.concat(F.lit(head), F.col("w"), F.lit(tail)).alias("feature"),
            ((F.col("w") - 1) * 4 + i + 1).alias("ord"),
            F.col(measure).alias("value"),
        )
        for i, (head, tail, measure) in enumerate(MEASURES)
    ]
    return cells(spark, sf).select("id", F.inline(F.array(*parts)))


def stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a stored table, for operators that read it more than once."""
    return stage(panel(spark, sf), "panel")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    name = F.concat(
        F.lit("m"), F.col("p_size") % 5 + 1, F.lit("q"), F.floor(F.col("p_partkey") / 5)
    )
    return part.select(name.alias("feature")).distinct()


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    """(id, task, truth, prediction, ybar_train, diff)."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("task"),
        "o_custkey", F.round(F.col("o_totalprice") * 100).alias("cents"), "o_orderstatus",
    )
    by_customer = orders.groupBy("o_custkey").agg(F.avg("cents").alias("prediction"))
    by_task = orders.groupBy("task").agg(F.avg("cents").alias("ybar_train"))
    joined = lookup_join(
        lookup_join(orders, stage(by_customer, "customer_means"), ["o_custkey"]),
        stage(by_task, "task_means"), ["task"],
    )
    truth = F.when(F.col("o_orderstatus") != "P", F.col("cents"))
    return joined.select(
        "id", "task", truth.alias("truth"), "prediction", "ybar_train",
        residual(truth, "prediction").alias("diff"),
    )


# Two tasks per order: the benchmark's residual, and the distance from the mean of the task.
TWO_TASKS_SQL = """two_tasks AS (
  SELECT id, 'benchmark' AS task, diff FROM residuals
  UNION ALL SELECT id, 'mean', truth - ybar_train FROM residuals)"""


def two_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = F.array(
        F.struct(F.lit("benchmark").alias("task"), F.col("diff")),
        F.struct(F.lit("mean").alias("task"), residual("truth", "ybar_train").alias("diff")),
    )
    return residuals(spark, sf).select("id", F.inline(tasks))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(id, chunk_index, score), several rows per id."""
    li = table(spark, sf, "lineitem")
    flag = (
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    )
    return li.select(
        F.col("l_orderkey").alias("id"),
        ((F.col("l_linenumber") - 1) * 3 + flag).alias("chunk_index"),
        ((F.round(F.col("l_tax") * 100) - 4) * F.round("l_extendedprice")).alias("score"),
    )


def task_scores(spark: SparkSession, sf: str, res: DataFrame) -> DataFrame:
    """Scores with the task of their id."""
    return lookup_join(scores(spark, sf), res.select("id", "task"), ["id"])


def chunk_dim(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that occur, with year and feature set."""
    return scores(spark, sf).select("chunk_index").distinct().select(
        "chunk_index",
        (F.floor(F.col("chunk_index") / 3) + 1).cast("int").alias("year"),
        (F.col("chunk_index") % 3).alias("chunk_index_without_year"),
    )


def user_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events as scored rows of their user: (id, event_id, score)."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"), "event_id", F.round(F.col("value") * 100).alias("score")
    )


def user_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Two tasks per user: the largest value, and the mean one."""
    per_user = user_scores(spark, sf).groupBy("id").agg(
        F.max("score").alias("top"), F.avg("score").alias("mid"), F.min("score").alias("low")
    )
    tasks = F.array(
        F.struct(F.lit("mid").alias("task"), F.col("mid").alias("truth"), (F.col("mid") * 0.9).alias("prediction"), F.lit(5000.0).alias("ybar_train")),
        F.struct(F.lit("top").alias("task"), F.col("top").alias("truth"), (F.col("mid") + F.col("low")).alias("prediction"), F.lit(20000.0).alias("ybar_train")),
    )
    return per_user.select("id", F.inline(tasks)).withColumn("diff", residual("truth", "prediction"))


USER_SQL = """user_scores AS (SELECT user_id AS id, event_id, round(value * 100) AS score FROM events),
users AS (SELECT id, max(score) AS top, avg(score) AS mid, min(score) AS low FROM user_scores GROUP BY id),
user_residuals AS (
  SELECT id, 'mid' AS task, mid AS truth, mid * 0.9 AS prediction, 5000.0::DOUBLE AS ybar_train, mid - mid * 0.9 AS diff FROM users
  UNION ALL SELECT id, 'top', top, mid + low, 20000.0::DOUBLE, top - (mid + low) FROM users)"""


def r2_sql(p: str, g: str, m: str) -> str:
    """SQL text of the holdout R2 over rows that carry the mean ``m``."""
    return f"1 - sum(({p} - {g}) * ({p} - {g})) / sum(({m} - {g}) * ({m} - {g}))"
