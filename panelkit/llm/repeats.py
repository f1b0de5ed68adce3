"""Windows of a text that also start in a document with a smaller id.

The two repeat removers share these steps; they differ in the values a text is
made of (words or bytes) and in how the doubtful runs are settled.

1. Every window of ``window`` values chooses one gram by its content alone, so
   equal windows choose equal grams at equal places (``grams.segments``).
   Neighbouring windows mostly agree; such a run is one row.
2. Rows meet by gram. A run whose whole span stands in a document with a
   smaller id is settled; a gram with one span only is unique. What stays in
   doubt are the runs at the borders of a repeat.
3. The doubtful runs are settled window by window.

No pair of documents is ever emitted, so a passage that stands in a third of
all documents costs as many rows as it has places. Before the shuffle a task
settles what it can among its own documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .store import stage

#: A place: text check (24 bits), settled flag and number of windows (8 bits), first value (32 bits).
_SETTLED = 0x80
_MOST = 0x7F

Values = Callable[[grams.Piece], tuple[np.ndarray, np.ndarray]]

RUNS = "h long, g long, doc long, at long"
FOUND = "h long, doc long, at long, settled boolean"


def word_values(piece: grams.Piece) -> tuple[np.ndarray, np.ndarray]:
    spans = grams.words(piece)
    return grams.prefix(grams.word_hashes(piece.data, spans)), spans.bounds


def byte_values(piece: grams.Piece) -> tuple[np.ndarray, np.ndarray]:
    return grams.prefix(grams.BYTE_VALUES[piece.data]), piece.offsets


def place(start: np.ndarray, count: np.ndarray, check: np.ndarray) -> np.ndarray:
    return (check.astype(np.int64) << 40) | (count.astype(np.int64) << 32) | start.astype(np.int64)


def start_of(at: np.ndarray) -> np.ndarray:
    return at & 0xFFFFFFFF


def count_of(at: np.ndarray) -> np.ndarray:
    return (at >> 32) & _MOST


def check_of(at: np.ndarray) -> np.ndarray:
    return (at >> 40) & 0xFFFFFF


def text_checks(piece: grams.Piece) -> np.ndarray:
    """24 bits of each text: rows that share an id by mistake keep their places apart."""
    text, at = memoryview(piece.data), piece.offsets.tolist()
    return np.array([zlib.crc32(text[a:b]) & 0xFFFFFF for a, b in zip(at, at[1:])], np.int64)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else _longs(x) for x in columns.values()], list(columns))


def runs(docs: DataFrame, values: Values, window: int, gram: int) -> DataFrame:
    """One row for each run of windows, keyed by gram ``h`` and span ``g``; runs settled inside the task are marked."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for piece in grams.pieces(batch.column(1)):
                sums, bounds = values(piece)
                found = grams.segments(sums, bounds, window, gram)
                if not len(found.start):
                    continue
                row = np.searchsorted(bounds, found.start, "right") - 1
                doc = ids[piece.first + row]
                start = found.start - bounds[row]
                order = np.lexsort((doc, found.span, found.anchor))
                h, g, d = found.anchor[order], found.span[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
                settled = d > least
                at = place(start[order], found.count[order] | np.where(settled, _SETTLED, 0), text_checks(piece)[row[order]])
                spread = grams.mix(at.view(np.uint64) ^ d.astype(np.int64).view(np.uint64))
                yield _table(h=np.where(settled, spread, h), g=np.where(settled, spread, g), doc=d, at=at)

    return docs.where(F.col("doc").isNotNull() & F.col("text").isNotNull()).mapInArrow(each, RUNS)


def settle(rows: DataFrame, parts: int) -> DataFrame:
    """Settled runs, and runs in doubt: the first of their span whose gram has other spans as well.

    Rows of a gram come sorted, so a task holds one batch and, of the gram
    under way, the runs of the smallest document, whatever its number of rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.zeros((4, 0), np.int64)
        held, ghost, several = empty, None, False
        for batch in batches:
            h, g, doc, at = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns)
            done = (at >> 32) & _SETTLED != 0
            if done.any():
                yield _table(h=h[done], doc=doc[done], at=at[done], settled=pa.array(np.ones(int(done.sum()), bool)))
            rest = np.stack([h, g, doc, at])[:, ~done]
            if not rest.shape[1]:
                continue
            lead = np.array(ghost, np.int64).reshape(4, 1) if ghost is not None and not held.shape[1] else empty
            h, g, doc, at = np.concatenate([lead, held, rest], axis=1)
            gram = np.ones(len(h), bool)
            gram[1:] = h[1:] != h[:-1]
            span = gram.copy()
            span[1:] |= g[1:] != g[:-1]
            least = doc[np.flatnonzero(span)][np.cumsum(span) - 1]
            group = np.cumsum(gram) - 1
            spans = np.bincount(group, weights=span)
            if ghost is not None and h[0] == ghost[0] and several:
                spans[0] += 1
            many = spans[group] > 1
            repeat = doc > least
            real = np.ones(len(h), bool)
            real[: lead.shape[1]] = False
            last = group == group[-1]
            out = real & (repeat | many)
            several = bool(spans[-1] > 1)
            held = empty if several else np.stack([h, g, doc, at])[:, last & ~repeat]
            ghost = (h[-1], g[-1], least[-1], 0)
            yield _table(h=h[out], doc=doc[out], at=at[out], settled=pa.array(repeat[out]))

    return rows.repartition(parts, "h").sortWithinPartitions("h", "g", "doc").mapInArrow(each, FOUND)


def window_rows(docs: DataFrame, doubtful: DataFrame, values: Values, window: int) -> DataFrame:
    """A row for each window of the doubtful runs: gram, window hash, document, place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, check, h, at, sums, base in doubtful_runs(batches, values):
            keep = check_of(at) == check
            h, at = h[keep], at[keep]
            n = count_of(at)
            first = np.repeat(start_of(at), n)
            inner = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            start = first + inner
            k = grams.slice_hash(sums, base + start, base + start + window)
            yield _table(h=np.repeat(h, n), k=k, doc=np.full(len(k), doc), at=place(start, np.ones(len(start), np.int64), np.full(len(start), check)))

    return _with_texts(docs, doubtful).mapInArrow(each, "h long, k long, doc long, at long")


def _with_texts(docs: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Documents with their doubtful runs; a list is bounded by its document's length."""
    lists = doubtful.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("runs"))
    return docs.join(lists, "doc").select("doc", "text", F.col("runs.h").alias("h"), F.col("runs.at").alias("at"))


def doubtful_runs(batches, values):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        hs, ats = batch.column(2), batch.column(3)
        for piece in grams.pieces(batch.column(1)):
            sums, bounds = values(piece)
            checks = text_checks(piece)
            for i in range(piece.last - piece.first):
                r = piece.first + i
                yield piece, ids[r], checks[i], hs[r].values.to_numpy(), ats[r].values.to_numpy(), sums, bounds[i]


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Places of windows whose content also starts in a document with a smaller id."""
    least = windows.groupBy("h", "k").agg(F.min("doc").alias("least"))
    return windows.join(least, ["h", "k"]).where("doc > least").select("doc", "at")


def covered_spans(at: np.ndarray, check: int, n: int, window: int) -> np.ndarray:
    """Maximal covered spans of a text of ``n`` values as rows (start, end)."""
    at = at[check_of(at) == check]
    first, many = start_of(at), count_of(at)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + many - 1 + window, -1)
    inside = np.cumsum(edge[:-1]) > 0
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Every document with the places found in it, or null."""
    lists = places.groupBy("doc").agg(F.collect_list("at").alias("at"))
    return docs.join(lists, "doc", "left").select("doc", "text", "at")


def parts_for(docs: DataFrame) -> int:
    """Shuffle parts: the session's number, which follows the size of the cluster's input."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def found(docs: DataFrame, values: Values, window: int, gram: int, name: str) -> DataFrame:
    return stage(settle(runs(docs, values, window, gram), parts_for(docs)), name)
