"""Joins of a large table with one-row-per-key tables.

The one-row side is broadcast only after its size was measured. Beyond the
bound the join shuffles; keys that hold very many rows of the large side are
found first, and only these are spread over ``salts`` tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..sources.staging import stage

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# No number, date or truth value takes more.
FIXED_BYTES = 16
# A key with more rows than this is worth spreading.
HOT_ROWS = 1_000_000
HOT_KEYS = 256
TRACKED_KEYS = 20_000
SALTS = 64

_WIDE = (ArrayType, BinaryType, MapType, StringType, StructType)

# Rows of one task where rows of a key meet: joins and groups then need the same memory at every size.
TASK_ROWS = 250_000
# Entries of one key that are packed into one list.
BLOCK_ENTRIES = 1000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by key over so many tasks that one gets about ``TASK_ROWS`` of ``rows``.

    Without the number, adaptive execution packs rows into few tasks, whose
    memory grows with the table.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(rows / TASK_ROWS)), *keys)


def is_small(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measured: at most ``max_rows`` rows and ``max_bytes`` bytes."""
    rows = df.count()
    if rows > max_rows:
        return False
    if not any(isinstance(f.dataType, _WIDE) for f in df.schema.fields):
        return rows * len(df.columns) * FIXED_BYTES <= max_bytes
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= max_bytes


def _top_keys(on: Sequence[str]) -> Column:
    return F.call_function("approx_top_k", F.xxhash64(*on), F.lit(HOT_KEYS), F.lit(TRACKED_KEYS))


def hot_keys(df: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """Hashes of the keys with about ``hot_rows`` rows or more.

    A heavy-hitter sketch over the key columns: one pass, merged from small
    partial sketches, at most ``HOT_KEYS`` results.
    """
    sketch = _top_keys(on)
    return _hot_of(df.agg(sketch.alias("top")).first()["top"], hot_rows)


def _hot_of(top: list | None, hot_rows: int) -> list[int]:
    return [r["item"] for r in top or [] if r["count"] >= hot_rows]


def lookup_join(
    many: DataFrame,
    one: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: bool = False,
    max_rows: int = MAX_BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``many`` rows with the ``one`` row of their key.

    ``how`` is inner, left, left_semi or left_anti. A derived ``one`` should be
    staged by the caller, as its size is measured before it is used. With
    ``spread`` no key can have many rows, and none is looked for; ``many`` is
    then counted, and a derived one should be staged too. A hot key
    that the sketch misses costs time only; the result is the same. Beyond the
    bound both sides are dealt over as many tasks as their rows need.
    """
    on = list(on)
    if is_small(one, max_rows):
        return many.join(F.broadcast(one), on, how)
    if spread:
        hot, rows = [], many.count()
    else:
        found = many.agg(_top_keys(on).alias("top"), F.count("*").alias("n")).first()
        hot, rows = _hot_of(found["top"], hot_rows), found["n"]
    rows += one.count()
    if not hot:
        return dealt(many, rows, *on).join(dealt(one, rows, *on), on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    row_hash = F.xxhash64(*[c for c, t in many.dtypes if not t.startswith("map")])
    salt = F.when(is_hot, F.pmod(row_hash, F.lit(salts)).cast("int")).otherwise(F.lit(0))
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = one.withColumn("_salt", F.explode(F.when(is_hot, all_salts).otherwise(F.array(F.lit(0)))))
    on = [*on, "_salt"]
    return dealt(many.withColumn("_salt", salt), rows, *on).join(dealt(copies, rows, *on), on, how).drop("_salt")


def fan_out(
    rows: DataFrame, few: DataFrame, on: Sequence[str], name: str = "few", block: int = BLOCK_ENTRIES
) -> DataFrame:
    """Repeat each row for the entries of its key, such as one per task.

    The entries of a key are packed into one row first, so that the join has a
    one-row side. A key with more than ``block`` entries is packed into several
    rows of at most ``block`` each, and only rows of such keys are repeated for
    the blocks before the join.
    """
    on = list(on)
    entry = F.struct(*[c for c in few.columns if c not in on])
    stored = stage(few, name)
    heavy = stage(
        stored.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > block), f"{name}_heavy"
    )
    if heavy.isEmpty():
        packed = stage(stored.groupBy(*on).agg(F.collect_list(entry).alias("_few")), name)
        return lookup_join(rows, packed, on).select(*rows.columns, F.inline("_few"))
    # ``block`` neighbours of a stored file share a number, so no list is longer.
    at = F.floor(F.monotonically_increasing_id() / block)
    placed = lookup_join(stored.withColumn("_at", at), heavy, on, "left")
    number = F.when(F.col("_n").isNotNull(), F.col("_at")).otherwise(F.lit(0)).cast("bigint")
    packed = stage(
        placed.withColumn("_block", number).groupBy(*on, "_block").agg(F.collect_list(entry).alias("_few")), name
    )
    index = stage(packed.groupBy(*on).agg(F.collect_list("_block").alias("_blocks")), f"{name}_blocks")
    repeated = lookup_join(rows, index, on).select(*rows.columns, F.explode("_blocks").alias("_block"))
    return lookup_join(repeated, packed, [*on, "_block"]).select(*rows.columns, F.inline("_few"))
