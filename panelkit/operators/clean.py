"""Cleaning, imputation by mean or mode, and the baseline features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..sources.staging import stage
from .joins import lookup_join

# Coded answers of the baseline indicators, the columns of the
# grade proxy, and the columns of a baseline table.
RACE_CODES = {"race_black": 2, "race_hispanic": 3}
RACE_OTHERS = "race_others"
MARITAL_CODES = {"marital_married": 1, "marital_cohab": 2}
MARITAL_OTHERS = "marital_others"
GPA_PROXY_COLUMNS = ("t5c13a", "t5c13b", "t5c13c")
BASELINE_COLUMNS = (
    "challengeID",
    "race_black", "race_hispanic", "race_others",
    "cm1edu",
    "marital_married", "marital_cohab", "marital_others",
)
OUTLIER_LOW = 0
OUTLIER_HIGH = 100
OUTLIER_LIST = 200


def clean_sentinels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: codes.sentinel_to_null(F.col(c).cast("double")) for c in cols})


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull())


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(cols) if cols else None)


def drop_outliers(
    df: DataFrame, label: str, low: float = OUTLIER_LOW, high: float = OUTLIER_HIGH
) -> DataFrame:
    return df.where(codes.within_open(label, low, high))


def list_outliers(df: DataFrame, label: str, above: float = OUTLIER_LIST) -> DataFrame:
    return df.where(F.col(label) > above)


def keep_ids(df: DataFrame, key: str, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows of the listed ids; the list may be a table."""
    if isinstance(ids, DataFrame):
        return lookup_join(df, stage(ids.select(key).distinct(), "ids"), [key], "left_semi")
    return df.where(F.col(key).isin(*ids))


def rekey(df: DataFrame, old: str = "family_id", new: str = "challengeID", shift: int = 1) -> DataFrame:
    """Rename the key and move it from 0-based to 1-based."""
    return df.withColumnRenamed(old, new).withColumn(new, F.col(new) + shift)


def owner_of_line(position: str, lines_per_owner: int = 2000) -> Column:
    return F.floor(F.col(position) / F.lit(lines_per_owner)).cast("bigint")


def lines_of_owner(owners: DataFrame, owner: str, lines_per_owner: int = 2000) -> DataFrame:
    """First and last line of each owner: the inverse of owner_of_line."""
    first = F.col(owner) * lines_per_owner
    return owners.select(
        owner, first.alias("first_line"), (first + lines_per_owner - 1).alias("last_line")
    )


def impute_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Negative codes to null, nulls to the column mean (of the group)."""
    clean = clean_sentinels(df, cols)
    means = [F.avg(c).alias(f"_m_{c}") for c in cols]
    return _fill(clean, clean.groupBy(*by).agg(*means), cols, by)


def impute_mode(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Negative codes to null, nulls to the most frequent value, smallest on ties."""
    clean = clean_sentinels(df, cols)
    cells = clean.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).alias("_v")) for c in cols])),
    ).where("_v is not null")
    counts = cells.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))
    modes = counts.groupBy(*by).agg(
        *[
            F.min(F.when(F.col("_c") == c, F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))))["v"]
            .alias(f"_m_{c}")
            for c in cols
        ]
    )
    return _fill(clean, modes, cols, by)


def _fill(clean: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    filled = {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}
    drop = [f"_m_{c}" for c in cols]
    if by:
        joined = lookup_join(clean, stage(stats, "fill"), by, "left")
        return joined.withColumns(filled).drop(*drop)
    # One row: a scalar subquery.
    one = stats.select(F.struct(*drop).alias("s")).scalar()
    return clean.withColumn("_s", one).withColumns(
        {c: F.coalesce(F.col(c), F.col("_s")[f"_m_{c}"]) for c in cols}
    ).drop("_s")


def add_indicators(df: DataFrame, value: str, mapping: Mapping[str, object], others: str) -> DataFrame:
    return df.select("*", *codes.indicators(value, mapping, others))


def proxy_feature(df: DataFrame, cols: Sequence[str] = GPA_PROXY_COLUMNS, out: str = "gpa_proxy") -> DataFrame:
    """Mean of several columns, each mean-imputed first."""
    return impute_mean(df, cols).withColumn(out, codes.row_mean(cols))


def label_join(outcomes: DataFrame, features: DataFrame, key: str, task: str) -> DataFrame:
    """Known outcomes of one task with the features of their id."""
    known = drop_null_target(outcomes.select(key, task), task)
    return lookup_join(known, features, [key])
