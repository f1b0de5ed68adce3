"""Quality scores by logistic regression over hashed word n-grams.

Tokens are runs of word characters or of other visible characters. A text's
features are the counts of its hashed tokens and token pairs, scaled to length
one; a token that follows itself counts as one feature whatever the token.
Weights are trained with follow-the-regularised-leader updates on a bounded
sample of the labelled rows: shards train side by side and their weights are
averaged. A score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from . import carried, grams
from .columns import free
from .store import stage

BITS = 18
#: Labelled rows that are learned from at most, picked by the hash of their id.
SAMPLE = 20_000
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.01, 0.05
HELD_OUT = 5

_OTHER = ~grams.ALPHANUMERIC & grams.SPACE_SEPARATED


def held_out(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % HELD_OUT == 0


def features(piece: grams.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all documents, and where each document's begin."""
    kinds = [grams.words(piece, member) for member in (grams.ALPHANUMERIC, _OTHER)]
    starts = np.concatenate([k.starts for k in kinds])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([k.ends for k in kinds])[order]
    bounds = kinds[0].bounds + kinds[1].bounds
    total = len(bounds) - 1
    hashes = grams.word_hashes(piece.data, grams.Words(starts, ends, bounds))
    pairs = grams.gram_hash(grams.prefix(hashes), 2)
    pairs[hashes[1:] == hashes[:-1]] = grams.mix(np.ones(1, np.uint64))[0]
    ok = grams.runs_inside(bounds, 2, len(starts))
    row = np.repeat(np.arange(total), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    slot = np.concatenate([hashes >> shift, grams.mix(pairs[ok]) >> shift]).astype(np.int64)
    key, count = np.unique((np.concatenate([row, row[: len(ok)][ok]]) << BITS) | slot, return_counts=True)
    first = np.searchsorted(key, np.arange(total + 1) << BITS)
    value = count.astype(np.float64)
    squares = np.concatenate([[0.0], np.cumsum(value * value)])
    norm = np.sqrt(squares[first[1:]] - squares[first[:-1]])
    value /= np.repeat(norm, np.diff(first))
    return key & ((1 << BITS) - 1), value, first


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sample(df: DataFrame, labels: DataFrame, text: str, id: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows outside the held-out part, as features."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(rows)  # at most ``rows`` short rows: the broadcast's bound
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "id").select("id", "text", "label")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                slot, value, first = features(piece)
                offsets = pa.array(first.astype(np.int32))
                rows = slice(piece.first, piece.last)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (slot.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(2)[rows], *lists], ["id", "label", "slots", "vals"])

    return docs.mapInArrow(each, "id long, label double, slots array<int>, vals array<float>")


def train(examples: DataFrame, shards: int = SHARDS) -> tuple[np.ndarray, float]:
    """Averaged weights, one for each slot, and the intercept. Without examples all are zero."""

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("id", "ascending")])
        y = table.column("label").to_numpy()
        slots = [np.asarray(x) for x in table.column("slots").to_numpy(zero_copy_only=False)]
        values = [np.asarray(x, np.float64) for x in table.column("vals").to_numpy(zero_copy_only=False)]
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        bias = bias_z = bias_n = 0.0
        for _ in range(EPOCHS):
            for i, x, label in zip(slots, values, y):
                at, seen = z[i], n[i]
                w = _weight(at, seen)
                bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
                error = 1.0 / (1.0 + np.exp(-np.clip(w @ x + bias, -35, 35))) - label
                g = error * x
                more = seen + g * g
                z[i] = at + g - (np.sqrt(more) - np.sqrt(seen)) / ALPHA * w
                n[i] = more
                bias_z += error - ((bias_n + error * error) ** 0.5 - bias_n**0.5) / ALPHA * bias
                bias_n += error * error
        w = _weight(z, n)
        used = np.flatnonzero(w)
        bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
        return pa.table({"slot": np.concatenate([[-1], used]), "weight": np.concatenate([[bias], w[used]])})

    order = examples.withColumn("order", F.xxhash64("id", F.lit(7))).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    parts = stage(order.groupBy("shard").applyInArrow(shard, "slot long, weight double"), "weights")
    found = max(parts.where("slot = -1").count(), 1)
    # At most 2**BITS + 1 rows, whatever the data.
    model = parts.groupBy("slot").agg((F.sum("weight") / found).alias("weight")).toArrow()
    slot, weight = model.column("slot").to_numpy(), model.column("weight").to_numpy()
    out = np.zeros(1 << BITS, np.float32)
    out[slot[slot >= 0]] = weight[slot >= 0]
    return out, float(weight[slot < 0].sum())


def _weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _chances(piece: grams.Piece, model: tuple[np.ndarray, float]) -> pa.Array:
    weights, bias = model
    slot, value, first = features(piece)
    return pa.array(1.0 / (1.0 + np.exp(-np.clip(_sums(weights[slot] * value, first) + bias, -35, 35))))


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id`` and ``score`` of every row, the chance of label 1."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[piece.first : piece.last], _chances(piece, model)], ["id", "score"])

    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(each, "id long, score double").withColumnRenamed("id", id)


def accepted(
    df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", threshold: float = 0.3, rows: int = SAMPLE,
) -> DataFrame:
    """The rows of ``df``, all columns as they are, that ``classify`` predicts as label 1; judged one by one in a single map."""
    model, chance = train(sample(df, labels, text, id, label, rows)), free(df, "score")
    scored = carried.with_columns(df, text, [(chance, T.DoubleType())], lambda: lambda _, piece: [_chances(piece, model)])
    return scored.where(F.col(chance) >= threshold).drop(chance)


def classify(
    df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality", threshold: float = 0.3, rows: int = SAMPLE,
) -> DataFrame:
    """``id, held_out, score, predicted`` of every row, trained on ``labels``.

    Rows whose id has crc32 divisible by five are never learned from. Only the
    text enters a score. Null and empty texts score as the intercept alone; a
    null id is not held out. Repeated ids are scored each by its own text;
    several labels of an id count by the lowest. Without labels all score 0.5.
    Other columns are not carried.
    """
    out = score(df, train(sample(df, labels, text, id, label, rows)), text, id)
    held = F.coalesce(held_out(id), F.lit(False))
    return out.select(id, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
