"""Deterministic samples and splits. All draws are hashes of row keys."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import digests, draws
from ..functions.arrays import dispersion
from ..functions.names import is_constructed
from ..sources.staging import stage
from .joins import lookup_join
from .ordering import number_ordered

# Fixed values of the corpus job.
SAMPLES_PER_ID = 2000
MIN_FEATURES = 60
MAX_FEATURES = 90
# Fixed values of the dispersion job.
SAMPLE_ROWS = 100
SAMPLE_REPEATS = 250


def shuffle(df: DataFrame, key: Sequence[str], seed: object) -> DataFrame:
    """All rows in the random order of ``seed``."""
    return df.orderBy(draws.draw_key(seed, *key), *key)


def hash_split(
    df: DataFrame, key: Sequence[str], test_size: float, seed: object, out: str = "split"
) -> DataFrame:
    """'test' for about ``test_size`` of the keys, else 'train'.

    With an id as key all rows of an id are on one side; with a row key the
    split is over rows.
    """
    side = F.when(draws.draw_below(seed, test_size, *key), "test").otherwise("train")
    return df.withColumn(out, side)


def ordered_split(df: DataFrame, key: str, share: float = 0.9, out: str = "split") -> DataFrame:
    """The first ceil(share * n) distinct ids in id order are 'train', the rest 'eval'."""
    ids = number_ordered(df.select(key).where(F.col(key).isNotNull()).distinct(), [key])
    ids = stage(ids, "split_ids")
    last = F.ceil(F.lit(share) * ids.agg(F.count("*")).scalar())
    cut = ids.where(F.col("row_no") == last).agg(F.max(key)).scalar()
    return df.withColumn(out, F.when(F.col(key) <= cut, "train").otherwise("eval"))


def rank_in_id(
    df: DataFrame, key: str, row: Sequence[str], k: int, seed: object, out: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per id in hash order, with their rank.

    Two levels: at most k rows per (id, hash digit) go on to the id's own
    ranking, so an id with very many rows is cut down in 256 places first.
    """
    drawn = df.withColumn("_draw", draws.draw_key(seed, key, *row))
    part = F.substring("_draw", 1, 2)
    first = Window.partitionBy(key, "_part").orderBy("_draw", *row)
    whole = Window.partitionBy(key).orderBy("_draw", *row)
    return (
        drawn.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
        .withColumn(out, F.row_number().over(whole)).where(F.col(out) <= k)
        .drop("_draw", "_part", "_r")
    )


def short_ids(df: DataFrame, key: str, k: int) -> DataFrame:
    """Ids with fewer than ``k`` rows, which cannot be sampled."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < k)


def sample_k_per_id(
    df: DataFrame, key: str, row: Sequence[str], k: int, seed: object, strict: bool = True
) -> DataFrame:
    """``k`` rows per id without replacement; a shorter id is an error."""
    picked = rank_in_id(df, key, row, k, seed)
    if not strict:
        return picked
    # At most k rows per id are left here.
    n = F.count("*").over(Window.partitionBy(key))
    message = F.concat(F.lit(f"fewer than {k} rows for "), F.col(key).cast("string"))
    return picked.withColumn("_n", n).withColumn(
        "rank", F.when(F.col("_n") >= k, F.col("rank")).otherwise(F.raise_error(message).cast("int"))
    ).drop("_n")


def k_means_per_id(
    df: DataFrame, key: str, row: Sequence[str], value: str, ks: Sequence[int], seed: object,
    strict: bool = True,
) -> DataFrame:
    """For each k the mean of k sampled values per id: (k, id, mean).

    One ranking serves all k: a row of rank r belongs to every k >= r.
    """
    ranked = rank_in_id(df.select(key, *row, value), key, row, max(ks), seed)
    fits = F.filter(F.array(*[F.lit(k) for k in sorted(ks)]), lambda k: k >= F.col("rank"))
    means = ranked.select(key, value, F.explode(fits).alias("k")).groupBy("k", key).agg(
        F.avg(value).alias("predicted_diff"), F.count("*").alias("_n")
    )
    if not strict:
        return means.drop("_n")
    message = F.concat(F.lit("too few rows for "), F.col(key).cast("string"))
    checked = F.when(F.col("_n") >= F.col("k"), F.col("predicted_diff")).otherwise(
        F.raise_error(message).cast("double")
    )
    return means.select("k", key, checked.alias("predicted_diff"))


def bernoulli(df: DataFrame, key: Sequence[str], share: float, seed: object) -> DataFrame:
    """Keep about ``share`` of the rows."""
    return df.where(draws.draw_below(seed, share, *key))


def subset_sizes(
    n_constructed: np.ndarray, n_raw: np.ndarray, seed: object, keys: Sequence[pa.Array],
    min_features: int, max_features: int,
) -> tuple[np.ndarray, np.ndarray]:
    """How many constructed and raw features one sample takes.

    The size is uniform in [min, max]; a third of it, rounded up, is
    constructed, the rest raw, each part limited by what the id has.
    """
    span = max_features - min_features + 1
    size = min_features + digests.draws_of(digests.joined([str(seed), "size", *keys])) % span
    part = np.minimum(-(-size // 3), n_constructed)
    return part, np.minimum(size - part, n_raw)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that are about to grow, over a stated number of partitions.

    A small shuffle grows into many samples: without the number, adaptive
    execution packs the rows into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Samples of an id that are drawn as one block, and the marks that are held at once.
BLOCK_SAMPLES = 64
HELD_MARKS = 1 << 21


def feature_subsets(
    cells: DataFrame,
    key: str,
    n_samples: int = SAMPLES_PER_ID,
    min_features: int = MIN_FEATURES,
    max_features: int = MAX_FEATURES,
    seed: object = 0,
    fields: Sequence[str] = ("ord", "feature", "value"),
    together: bool = False,
) -> DataFrame:
    """Random feature subsets per id, drawn inside the id's own row.

    ``cells`` is (key, ord, feature, value) with one row per filled cell; an
    id has one cell per feature at most, so its list is as wide as the panel.
    The list is sorted once; a sample then costs a draw for each feature it
    takes, not for each it could take, and the draws of many ids are made at
    once with arrays. After the grouping nothing is shuffled, whatever the
    number of samples. With ``together`` the rows of an id already share a
    partition, and there are enough of these.
    Result: (key, sample_no, cells) with the cells in ``ord`` order, of each its ``fields``.
    """
    others = [f for f in fields if f not in ("ord", "feature", "value")]
    cell = F.struct("ord", "feature", "value", *others)
    filled = cells.where(F.col("value").isNotNull() & (F.col("value") >= 0))
    listed = (filled if together else _spread(filled, key)).groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("_listed"))
    block = F.explode(F.sequence(F.lit(1), F.lit(n_samples), F.lit(BLOCK_SAMPLES)))
    blocks = listed.select(
        key, F.col(key).cast("string").alias("_key"), F.transform("_listed", lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("cells"),
        F.transform("_listed", lambda c: is_constructed(c["feature"])).alias("_constructed"), block.alias("_first"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _drawn(batch, n_samples, min_features, max_features, seed)

    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    return blocks.mapInArrow(run, f"`{key}` {kinds[key]}, sample_no int, cells {kinds['cells']}")


def _drawn(batch: pa.RecordBatch, n_samples: int, min_features: int, max_features: int, seed: object) -> Iterator[pa.RecordBatch]:
    """The samples of blocks (key, its text, cells, their class, first sample)."""
    key, text, cells, constructed, first = batch.columns
    width = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    start, most = np.cumsum(width) - width, int(width.max(initial=0))
    owner = np.repeat(np.arange(len(key)), width)
    place = np.arange(len(owner)) - start[owner]
    flags, strata = constructed.flatten(), {}
    # A cell without a name has no class and is never drawn.
    for name, is_mine in (("constructed", flags), ("raw", pc.invert(flags))):
        mine = pc.fill_null(is_mine, False).to_numpy(zero_copy_only=False)
        n = np.bincount(owner[mine], minlength=len(key))
        table = np.zeros((len(key), most), dtype=np.int32)
        table[owner[mine], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = place[mine]
        strata[name] = n, table
    begin, flat = first.to_numpy().astype(np.int64), cells.flatten()
    count = np.minimum(BLOCK_SAMPLES, n_samples - begin + 1)
    held = max(1, HELD_MARKS // (min(BLOCK_SAMPLES, n_samples) * max(1, most)))
    for i in range(0, len(key), held):
        of = count[i : i + held]
        own = np.repeat(np.arange(i, i + len(of)), of)
        number = begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(of) - of, of)
        keys = [text.take(pa.array(own)), pa.array(number).cast(pa.string())]
        n_of = {name: n[own] for name, (n, _) in strata.items()}
        sizes = subset_sizes(n_of["constructed"], n_of["raw"], seed, keys, min_features, max_features)
        chosen = np.zeros((len(own), most), dtype=bool)
        for (name, (_, table)), size in zip(strata.items(), sizes):
            digests.mark_subsets(chosen, n_of[name], size, digests.joined([str(seed), name, *keys]), table, own)
        row, taken = np.nonzero(chosen)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(own)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(start[own[row]] + taken)))
        yield pa.RecordBatch.from_arrays([key.take(pa.array(own)), pa.array(number, pa.int32()), lists], [batch.schema.names[0], "sample_no", "cells"])


def _numbered_rows(vectors: DataFrame, key: str, row: str) -> DataFrame:
    numbered = number_ordered(vectors.select(key, row), [row], within=[key], out="_no")
    return stage(numbered.withColumn("_pos", F.col("_no") - 1).drop("_no"), "numbered")


def same_id_samples(
    vectors: DataFrame, key: str, row: str, n: int = SAMPLE_ROWS, repeats: int = SAMPLE_REPEATS, seed: object = 0
) -> DataFrame:
    """``repeats`` samples of ``n`` different rows inside each id: (key, repeat, row)."""
    numbered = _numbered_rows(vectors, key, row)
    sizes = numbered.groupBy(key).agg(F.count("*").alias("_m"))
    samples = sizes.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    picks = _spread(samples, key, "repeat").select(
        key,
        "repeat",
        F.explode(draws.distinct_draws(F.col("_m"), n, seed, F.lit("same"), key, "repeat")).alias("_pos"),
    )
    return picks.join(numbered, [key, "_pos"]).select(key, "repeat", row)


def mixed_id_samples(
    vectors: DataFrame, key: str, row: str, n: int = SAMPLE_ROWS, repeats: int = SAMPLE_REPEATS, seed: object = 0
) -> DataFrame:
    """As many samples as same_id_samples takes, each of ``n`` different ids.

    One random row stands for each picked id: (sample_no, key, row).
    """
    numbered = _numbered_rows(vectors, key, row)
    sizes = numbered.groupBy(key).agg(F.count("*").alias("_m"))
    ids = stage(number_ordered(sizes, [key], out="_id_no"), "ids")
    n_ids = F.lit(ids.count())
    samples = ids.select(
        F.explode(
            F.sequence((F.col("_id_no") - 1) * repeats + 1, F.col("_id_no") * repeats)
        ).alias("sample_no")
    )
    picks = _spread(samples, "sample_no").select(
        "sample_no",
        F.explode(draws.distinct_draws(n_ids, n, seed, F.lit("mixed"), "sample_no")).alias("_p"),
    ).withColumn("_id_no", F.col("_p") + 1)
    placed = lookup_join(picks, ids, ["_id_no"]).select(
        "sample_no",
        key,
        F.pmod(draws.draw_int(seed, F.lit("row"), "sample_no", key), F.col("_m")).alias("_pos"),
    )
    return placed.join(numbered, [key, "_pos"]).select("sample_no", key, row)


def sample_dispersion(
    samples: DataFrame, sample: Sequence[str], vectors: DataFrame, row: str, vector: str, dim: int
) -> DataFrame:
    """Mean distance to the centroid for each sample of known size."""
    joined = samples.join(vectors.select(row, vector), row)
    # A sample has the n rows that were drawn for it: a short list.
    listed = joined.groupBy(*sample).agg(
        F.count("*").alias("n_rows"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(row, vector))), lambda x: x[vector]
        ).alias("_vectors"),
    )
    return listed.select(*sample, "n_rows", dispersion(F.col("_vectors"), dim).alias("dispersion"))
