"""Row numbers and running totals over a whole table without a one-task sort.

Both ways cut the table into pieces that keep the order, total the pieces,
and add the total of the earlier pieces to the numbers inside a piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import draw_key
from ..sources.staging import stage

PIECE_ROWS = 1_000_000


def number_shuffled(df: DataFrame, key: Sequence[str], seed: object, out: str = "row_no") -> DataFrame:
    """1-based row number in the random order of ``seed``.

    Pieces are the first four hex digits of the draw, so there are at most
    65,536 of them and each has the same share of the rows. ``key`` must tell
    rows apart.
    """
    drawn = df.withColumn("_draw", draw_key(seed, *key))
    piece = F.substring("_draw", 1, 4).alias("_piece")
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        drawn.groupBy(piece).count()
        .select("_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_piece").orderBy("_draw", *key)
    return (
        drawn.withColumn("_piece", piece)
        .join(F.broadcast(offsets), "_piece")  # at most 65,536 rows
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_piece", "_draw", "_before")
    )


def renumber(df: DataFrame, number: str, out: str, upper: int) -> DataFrame:
    """Close the gaps in a unique 0-based ``number`` below ``upper``: 1, 2, 3, ...

    Pieces are ranges of the number itself, at most ``upper / PIECE_ROWS + 1``
    of them (and never more than 65,536, where the ranges get longer).
    """
    width = max(PIECE_ROWS, upper // 65_535 + 1)
    pieces = df.withColumn("_piece", F.floor(F.col(number) / F.lit(width)))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy("_piece").count()
        .select("_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_piece").orderBy(number)
    return (
        pieces.join(F.broadcast(offsets), "_piece")  # at most 65,536 rows
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_piece", "_before")
    )


def in_pieces(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition by ``order`` and keep the piece number as ``_piece``.

    Range bounds come from a sample, so the result is staged: every later
    step sees the same pieces. There are ``spark.sql.shuffle.partitions`` of
    them.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(pieces, *[F.col(c) for c in order])
    return stage(ranged.withColumn("_piece", F.spark_partition_id()), "ranged")


def number_ordered(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    out: str = "row_no",
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """1-based row number, and running totals, in the order of given columns.

    ``within`` restarts them per group; a group may be as large as the table,
    as it is cut into pieces too. ``order`` must tell the rows of a group
    apart. ``totals`` maps a new column to the column it adds up.
    """
    totals = dict(totals or {})
    pieces = in_pieces(df, [*within, *order])
    sums = [F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()]]
    earlier = (
        Window.partitionBy(*within).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Only the group at the front of a piece can have begun in an earlier one,
    # so at most one row per piece is left here.
    carried = (
        pieces.groupBy("_piece", *within).agg(*sums)
        .select(
            "_piece",
            *within,
            F.sum("_n").over(earlier).alias("_before"),
            *[F.sum(f"_t_{o}").over(earlier).alias(f"_b_{o}") for o in totals],
        )
        .where(F.col("_before").isNotNull())
    )
    inside = Window.partitionBy("_piece", *within).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.join(F.broadcast(carried), ["_piece", *within], "left")
    return numbered.select(
        *df.columns,
        (F.row_number().over(inside) + F.coalesce("_before", F.lit(0))).alias(out),
        *[
            (F.sum(c).over(running) + F.coalesce(f"_b_{o}", F.lit(0))).alias(o)
            for o, c in totals.items()
        ],
    )
