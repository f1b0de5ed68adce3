"""Result tables: pivots, grids and stacks. Value lists are always given."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import FOUR_FACTOR_R2
from ..sources.staging import stage
from .joins import lookup_join

# Sample sizes, score grid years and feature sets, chunk count.
K_VALUES = (1, 5, 10, 20, 100)
GRID_YEARS = (1, 2, 3, 4)
GRID_SETS = tuple(range(27))
N_CHUNKS = 67


def _listed(column: str, allowed: Sequence[object]) -> Column:
    """The column; a value outside the list is an error, as a pivot would drop its rows."""
    outside = F.concat(F.lit(f"{column} outside the given list: "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(outside))


def _one(value: str, what: str):
    """Aggregate: the only value of a cell; two values are an error."""
    return F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(
        F.raise_error(F.lit(f"more than one {what} in a cell")).cast("double")
    )


def pivot_chunk_predictions(
    preds: DataFrame, chunks: Sequence[int] = tuple(range(N_CHUNKS)), value: str = "predicted_diff"
) -> DataFrame:
    """(id, task) x chunk, null where a chunk has no prediction."""
    preds = preds.withColumn("chunk_index", _listed("chunk_index", chunks))
    return preds.groupBy("id", "task").pivot("chunk_index", list(chunks)).agg(_one(value, "prediction"))


def pivot_k(results: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    return results.withColumn("k", _listed("k", ks)).groupBy("task").pivot("k", list(ks)).agg(_one("R", "score"))


def attach_chunks(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Year, wave set and columns of each scored chunk."""
    return lookup_join(results, chunks, ["chunk_index"])


def subtract_baseline(results: DataFrame, baseline: Mapping[str, float] = FOUR_FACTOR_R2) -> DataFrame:
    """``gain`` = R minus the baseline of the task; a task without a baseline is an error."""
    table = results.sparkSession.createDataFrame(list(baseline.items()), "task string, _base double")
    joined = lookup_join(results, table, ["task"], "left")
    absent = F.raise_error(F.concat(F.lit("no baseline for task "), F.coalesce("task", F.lit("null"))))
    base = F.when(F.col("_base").isNotNull(), F.col("_base")).otherwise(absent.cast("double"))
    return joined.withColumn("gain", F.col("R") - base).drop("_base")


def score_grid(
    results: DataFrame, sets: Sequence[int] = GRID_SETS, years: Sequence[int] = GRID_YEARS,
    value: str = "gain", set_column: str = "chunk_index_without_year",
) -> DataFrame:
    """(task, year) x feature set; empty cells are null, double cells an error."""
    rows = results.withColumn("year", _listed("year", years)).withColumn(set_column, _listed(set_column, sets))
    return rows.groupBy("task", "year").pivot(set_column, list(sets)).agg(_one(value, "score"))


def grid_range(results: DataFrame, value: str = "gain") -> DataFrame:
    """Lowest and highest score per task, nulls skipped."""
    return results.groupBy("task").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def stack_results(parts: Mapping[object, DataFrame], column: str) -> DataFrame:
    """Result tables on top of each other, with the name of the part."""
    out: DataFrame | None = None
    for name, part in parts.items():
        tagged = part.withColumn(column, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A preview in a stated order."""
    return df.orderBy(*order).limit(n)


def staged_results(df: DataFrame) -> DataFrame:
    """Results that several reports read."""
    return stage(df, "results")
