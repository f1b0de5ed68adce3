"""Vector statistics: centroids, dispersion, pooling, blocks of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2_distance
from ..sources.staging import stage
from .joins import lookup_join
from .ordering import number_ordered

BLOCK_ROWS = 1024


def group_mean(df: DataFrame, keys: Sequence[str], vector: str, out: str = "mean") -> DataFrame:
    """Mean vector and row count per group, summed up before the shuffle."""
    rows = df.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return rows.groupBy(*keys).agg(
        Summarizer.mean(F.col("_v")).alias("_mean"), F.count("*").alias("n_rows")
    ).select(*keys, vector_to_array("_mean").alias(out), "n_rows")


def centroid_dispersion(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean distance of a group's vectors to their centroid, any group size.

    Two passes: the centroids, then the distances averaged before the shuffle.
    """
    centroids = stage(group_mean(df, keys, vector, "_centroid"), "centroids")
    joined = lookup_join(
        df.select(*keys, F.col(vector).cast("array<double>").alias("_v")), centroids, keys
    )
    distance = l2_distance(F.col("_v"), F.col("_centroid"))
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.avg(distance).alias("dispersion")
    )


def token_mean(token_vectors: Column, mask: Column | None = None) -> Column:
    """Mean token vector of one row; without a mask padding counts too."""
    tokens = token_vectors
    if mask is not None:
        tokens = F.filter(token_vectors, lambda _, i: F.get(mask, i) == 1)
    dims = F.size(F.get(token_vectors, F.lit(0)))
    zero = F.transform(F.sequence(F.lit(1), dims), lambda _: F.lit(0.0))
    total = F.aggregate(
        tokens, zero, lambda s, v: F.zip_with(s, v.cast("array<double>"), lambda x, y: x + y)
    )
    return F.transform(total, lambda x: x / F.size(tokens))


def mean_pool(
    df: DataFrame, keys: Sequence[str], token_vectors: str, mask: str | None = None,
    out: str = "embedding",
) -> DataFrame:
    """Token vectors -> row means -> mean per id."""
    rows = df.select(
        *keys,
        token_mean(F.col(token_vectors), F.col(mask) if mask else None).alias("_row"),
    )
    return group_mean(rows, keys, "_row", out)


def matrix_blocks(
    df: DataFrame, key: str, row: str, values: str, label: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All rows of an id as a matrix, in blocks of at most ``block_rows`` rows.

    The blocks of an id, in order, are its matrix; ``label`` is the label of
    its first row. An id of any size is spread over its blocks.
    """
    numbered = stage(
        number_ordered(df.select(key, row, values, label), [row], within=[key], out="_no"), "matrix"
    )
    first = numbered.where("_no = 1").select(key, label)
    block = F.floor((F.col("_no") - 1) / F.lit(block_rows)).alias("block_no")
    # ``block_rows`` rows per list at most.
    listed = F.array_sort(F.collect_list(F.struct("_no", values)))
    blocks = numbered.groupBy(key, block).agg(
        F.count("*").alias("n_rows"), F.transform(listed, lambda x: x[values]).alias("matrix")
    )
    return lookup_join(blocks, stage(first, "first_labels"), [key])


def histogram(
    df: DataFrame, value: str, width: float, by: Sequence[str] = (), low: float = 0.0
) -> DataFrame:
    """Counts of values in bins of one width."""
    bin_no = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("bigint")
    return df.groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("n")).withColumn(
        "bin_start", F.lit(low) + F.col("bin") * F.lit(width)
    )
