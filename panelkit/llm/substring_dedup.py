"""Substring removal by seed and extend, over words.

Seeds are winnowed anchors: of the ``window - SEED + 1`` word grams in a window
the one with the smallest hash, so every repeat of ``window`` words holds an
anchor that both sides chose. Documents meet by anchor. A match is extended to
both sides at once: first over the whole run of windows that chose the anchor,
then, where the run differs, over each place that a window of the required
length can have around it. Overlapping extensions join to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, repeats
from .store import stage

SEED = 8


def remove_repeats(df: DataFrame, text: str = "text", id: str = "doc_id", window: int = 50) -> DataFrame:
    """Each document without the words of repeats that also stand in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``. Returns one row per input row: the id,
    ``n_words``, ``n_removed``, ``spans`` (maximal removed runs of words, end
    exclusive) and ``kept`` (the other words joined by one space). Judged on
    the input, never on what is left.

    Null and empty texts have no words. A row without id keeps all words and
    is no source. Rows that share an id are no sources for each other. Other
    columns are not carried, whatever their names.
    """
    if not SEED <= window <= SEED + 126:
        raise ValueError(f"window must lie between {SEED} and {SEED + 126}")
    docs = df.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    found = repeats.found(docs, repeats.word_values, window, SEED, "anchors")
    windows = stage(repeats.window_rows(docs, found.where("not settled"), repeats.word_values, window), "extensions")
    places = found.where("settled").select("doc", "at").unionByName(repeats.repeated_windows(windows))
    places = stage(places, "repeats")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                spans = grams.words(piece)
                checks = repeats.text_checks(piece)
                n = np.diff(spans.bounds)
                removed, cut, kept = np.zeros(len(n), np.int64), [], []
                for i in range(len(n)):
                    at = batch.column(2)[piece.first + i]
                    low, high = spans.bounds[i], spans.bounds[i + 1]
                    out = repeats.covered_spans(at.values.to_numpy(), checks[i], int(n[i]), window) if at.is_valid else np.zeros((0, 2), np.int64)
                    removed[i] = (out[:, 1] - out[:, 0]).sum()
                    cut.append([{"start": int(a), "end": int(b)} for a, b in out])
                    kept.append(_joined(piece.data, spans.starts[low:high], spans.ends[low:high], out))
                rows = slice(piece.first, piece.last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(n), pa.array(removed), pa.array(cut, _SPANS), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc", "n_words", "n_removed", "spans", "kept"],
                )

    schema = "doc long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
    return repeats.with_places(docs, places).mapInArrow(each, schema).withColumnRenamed("doc", id)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, out: np.ndarray) -> bytes:
    """The words outside ``out`` joined by one space."""
    keep = np.ones(len(starts), bool)
    for a, b in out:
        keep[a:b] = False
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    size = ends - starts + 1
    total = int(size.sum())
    offset = np.cumsum(size) - size
    source = np.repeat(starts - offset, size) + np.arange(total)
    last = offset + size - 1
    source[last] = 0
    joined = data[source]
    joined[last] = 32
    return joined[:-1].tobytes()
