"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a
sketch brackets the wanted rank first; the second pass counts what lies below
the bracket and keeps apart only the values inside it (well under 0.1 % of
the group), which are few enough to sort. The counts show whether the bracket
held the rank; if it ever did not, the job fails rather than answer wrongly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .joins import lookup_join

ACCURACY = 10_000


def rank_steps(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Sequence[float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Counts along the value axis, fine near each share, coarse elsewhere.

    One row per (keys, point, gap): ``n`` values equal ``point``, or, with
    ``gap``, lie after ``point`` and before the next bracket (a null point is
    the gap below all brackets). ``upto`` is the running count, ``n_total``
    the size of the group. Null values are left out.
    """
    margin = 4.0 / accuracy
    lows = [max(0.0, s - margin) for s in shares]
    highs = [min(1.0, s + margin) for s in shares]
    k = len(shares)
    whole = not keys
    keys = list(keys) or ["_all"]
    known = df.where(F.col(value).isNotNull())
    known = known.withColumn("_all", F.lit(0)) if whole else known
    rows = known.select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", [*lows, *highs], accuracy).alias("_cuts"),
    )
    small = F.col("n_total") <= accuracy
    brackets = sketch.select(
        *keys,
        "n_total",
        *[F.when(small, F.col("_min")).otherwise(F.col("_cuts")[i]).alias(f"_lo{i}") for i in range(k)],
        *[F.when(small, F.col("_max")).otherwise(F.col("_cuts")[k + i]).alias(f"_hi{i}") for i in range(k)],
    )
    stored = stage(brackets, "brackets")
    if whole:  # one row of brackets
        one = stored.drop("_all").select(F.struct("*")).scalar()
        joined = rows.withColumn("_b", one).select("_all", "_v", "_b.*")
    else:
        joined = lookup_join(rows, stored, keys)
    inside = F.lit(False)
    for i in range(k):
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
    passed = [F.when(F.col("_v") > F.col(f"_hi{i}"), F.col(f"_hi{i}")) for i in range(k)]
    last = passed[0] if k == 1 else F.greatest(*passed)
    along = Window.partitionBy(*keys).orderBy(F.col("point").asc_nulls_first(), "gap")
    return (
        joined.groupBy(
            *keys, "n_total",
            F.when(inside, F.col("_v")).otherwise(last).alias("point"),
            (~inside).alias("gap"),
        )
        .agg(F.count("*").alias("n"))
        .withColumn(
            "upto", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        )
    )


def value_at(rank: Column) -> Column:
    """Aggregate over rank_steps: the value of the 0-based ``rank``."""
    hit = F.min(F.when(F.col("upto") > rank, F.struct("point", "gap")))
    return F.when(~hit["gap"], hit["point"]).otherwise(
        F.raise_error(F.lit("the bracket missed its rank; raise the accuracy")).cast("double")
    )


def quantile_at(share: float) -> Column:
    """Aggregate over rank_steps: quantile with linear interpolation."""
    place = (F.col("n_total") - 1) * F.lit(float(share))
    low, high = value_at(F.floor(place)), value_at(F.ceil(place))
    part = F.max(place - F.floor(place))
    return low + (high - low) * part


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    shares: Mapping[str, float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group: ``n`` non-null values and the named quantiles."""
    steps = rank_steps(df, keys, value, list(shares.values()), accuracy)
    return steps.groupBy(*(keys or ["_all"])).agg(
        F.max("n_total").alias("n"),
        *[quantile_at(s).alias(name) for name, s in shares.items()],
    ).drop("_all")
