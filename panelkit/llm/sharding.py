"""Shard placement by a lookup table that shards fill by their own permutations.

Each shard walks the slots of a prime-sized table in an order of its own. The
shards take turns; on its turn a shard claims the first slot of its order that
is still free. Every shard gets the same number of slots, give or take one, and
when a shard leaves or joins, few other slots change hands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime. More than a hundred slots a shard keep the shares even; the table is broadcast, so its size has a bound.
SLOTS = 2039
MOST_SLOTS = 65_537


def number(value: Column) -> Column:
    """A number below 2**32 from a text, the same in every engine."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` for every slot. ``slots`` must be prime and at least the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not len(shards) <= slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    one = spark.range(1).select(F.array(*(F.lit(s) for s in shards)).alias("names"))
    walk = one.select(
        "names",
        F.transform("names", lambda s: number(F.concat(s, F.lit(":offset"))) % slots).alias("start"),
        F.transform("names", lambda s: number(F.concat(s, F.lit(":skip"))) % (slots - 1) + 1).alias("skip"),
    )
    fill = F.expr(f"""
        aggregate(sequence(0, {slots} - 1), array_repeat(-1, {slots}), (taken, turn) ->
          transform(array(filter(sequence(0, {slots} - 1), j ->
              taken[cast((start[turn % {len(shards)}] + j * skip[turn % {len(shards)}]) % {slots} AS int)] = -1)[0]), j ->
            transform(array(cast((start[turn % {len(shards)}] + j * skip[turn % {len(shards)}]) % {slots} AS int)), slot ->
              concat(slice(taken, 1, slot), array(turn % {len(shards)}), slice(taken, slot + 2, {slots})))[0])[0])""")
    filled = walk.select("names", F.posexplode(fill).alias("slot", "at"))
    return filled.select("slot", F.get("names", F.col("at")).alias("shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` of each row, a broadcast lookup without shuffle.

    The table has ``slots`` rows, at most ``MOST_SLOTS``, whatever the data.
    Rows with equal keys share a shard; a key that holds a large part of all
    rows therefore needs a further column in ``keys`` to spread. Null parts of
    a key count as empty. Columns named ``slot`` and ``shard`` are replaced.
    """
    key = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots))
    return df.drop("slot", "shard").withColumn("slot", (number(key) % slots).cast("int")).join(table, "slot", "left")
