"""Substring removal by suffix buckets over UTF-8 bytes, refined by bucket pointers.

Suffixes start in the bucket of their first ``GRAM`` bytes. Only sampled
suffixes enter the first round, those that some window chose by content; every
repeated string of ``window`` bytes holds one at the same place on all sides.
A bucket with a single member is finished, and so is a run whose whole span
stands in a document with a smaller id. In the buckets left, the suffixes of
the runs are refined: their q-gram buckets are sorted by the pair of their own
bucket and the bucket at a later offset, and the new buckets serve as pointers
of the next round, until they stand for ``window`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, repeats
from .store import stage

GRAM = 20
#: First bucket of the refinement, in bytes.
FIRST = 7
#: A bucket with more runs is split by window content over all tasks instead of refined in one.
BUCKET_ROWS = 20_000


def remove_repeats(
    df: DataFrame, text: str = "text", id: str = "doc_id", window: int = 50, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Each document without the bytes of strings that also start in a document with a smaller id.

    Returns one row per input row: the id, ``n_bytes``, ``n_removed``,
    ``spans`` (maximal removed runs of bytes, end exclusive) and ``kept``
    (binary, the other bytes). Matches never cross documents; overlaps count.

    Null texts are empty. A row without id keeps all bytes and is no source.
    Rows that share an id are no sources for each other. Other columns are not
    carried, whatever their names. ``bucket_rows`` moves work, not results.
    """
    if not GRAM <= window <= GRAM + 126:
        raise ValueError(f"window must lie between {GRAM} and {GRAM + 126}")
    docs = df.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    found = repeats.found(docs, repeats.byte_values, window, GRAM, "buckets")
    doubtful = found.where("not settled").select("h", "doc", "at")
    large = stage(doubtful.groupBy("h").count().where(F.col("count") > bucket_rows).select("h", F.lit(True).alias("large")), "large")
    doubtful = stage(doubtful.join(large, "h", "left"), "doubtful")
    windows = repeats.window_rows(docs, doubtful.where("large"), repeats.byte_values, window)
    windows = stage(windows, "windows")
    refined = refine(spans_of(docs, doubtful.where("large is null"), window), window, repeats.parts_for(docs))
    places = found.where("settled").select("doc", "at").unionByName(refined).unionByName(repeats.repeated_windows(windows))
    places = stage(places, "repeats")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                checks = repeats.text_checks(piece)
                n = np.diff(piece.offsets)
                removed, cut, kept = np.zeros(len(n), np.int64), [], []
                for i in range(len(n)):
                    at = batch.column(2)[piece.first + i]
                    own = piece.data[piece.offsets[i] : piece.offsets[i + 1]]
                    if not at.is_valid:
                        cut.append([])
                        kept.append(own.tobytes())
                        continue
                    out = repeats.covered_spans(at.values.to_numpy(), checks[i], len(own), window)
                    removed[i] = (out[:, 1] - out[:, 0]).sum()
                    cut.append([{"start": int(a), "end": int(b)} for a, b in out])
                    edges = np.concatenate([[0], out.ravel(), [len(own)]])
                    kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.first : piece.last], pa.array(n), pa.array(removed), pa.array(cut, _SPANS), pa.array(kept, pa.binary())],
                    ["doc", "n_bytes", "n_removed", "spans", "kept"],
                )

    schema = "doc long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return repeats.with_places(docs, places).mapInArrow(each, schema).withColumnRenamed("doc", id)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def spans_of(docs: DataFrame, doubtful: DataFrame, window: int) -> DataFrame:
    """The doubtful runs with the bytes that their windows cover."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for piece in grams.pieces(batch.column(1)):
                checks = repeats.text_checks(piece)
                for i in range(piece.last - piece.first):
                    r = piece.first + i
                    h, at = batch.column(2)[r].values.to_numpy(), batch.column(3)[r].values.to_numpy()
                    keep = repeats.check_of(at) == checks[i]
                    h, at = h[keep], at[keep]
                    raw = piece.data[piece.offsets[i] : piece.offsets[i + 1]].tobytes()
                    first = repeats.start_of(at)
                    last = first + repeats.count_of(at) - 1 + window
                    out[0].append(h)
                    out[1].append(np.full(len(h), batch.column(0)[r].as_py()))
                    out[2].append(at)
                    out[3] += [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
            if out[3]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out[:3]), pa.array(out[3], pa.binary())], ["h", "doc", "at", "span"])

    return repeats._with_texts(docs, doubtful).mapInArrow(each, "h long, doc long, at long, span binary")


def refine(runs: DataFrame, window: int, parts: int) -> DataFrame:
    """Places of windows whose bucket, refined to ``window`` bytes, holds a smaller document.

    Buckets come sorted; a task refines as many whole buckets at once as fit
    ``BUCKET_ROWS`` rows, the bound of its memory.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            if rows.num_rows < BUCKET_ROWS:
                continue
            h = rows.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            yield from _refined(rows.slice(0, whole), window)
            held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield from _refined(pa.Table.from_batches(held), window)

    return runs.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(each, "doc long, at long")


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Bucket numbers of the sorted distinct keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        held = key[order]
        new[1:] |= held[1:] != held[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _refined(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    h, doc, at = (rows.column(x).to_numpy() for x in ("h", "doc", "at"))
    spans = rows.column("span").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(spans.buffers()[1], np.int64)[spans.offset : spans.offset + len(spans) + 1]
    data = np.frombuffer(spans.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # A gram of FIRST bytes is its own bucket number.
    padded = np.concatenate([data, np.zeros(FIRST - 1, np.uint8)]).astype(np.int64)
    bucket = np.zeros(len(data), np.int64)
    for i in range(FIRST):
        bucket = (bucket << 8) | padded[i : i + len(data)]
    length = FIRST
    while length < window:
        step = min(length, window - length)
        later = np.zeros(len(bucket), np.int64)
        later[:-step] = bucket[step:]
        bucket, length = _ranks(bucket, later), length + step
    n = repeats.count_of(at)
    row = np.repeat(np.arange(len(at)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    final = bucket[offsets[row] + inner]
    order = np.lexsort((doc[row], final))
    new = np.ones(len(order), bool)
    new[1:] = final[order][1:] != final[order][:-1]
    held = doc[row][order]
    repeat = order[held > held[np.flatnonzero(new)][np.cumsum(new) - 1]]
    start = repeats.start_of(at)[row[repeat]] + inner[repeat]
    # Neighbouring places of a row become one place.
    o = np.lexsort((start, row[repeat]))
    row, start = row[repeat][o], start[o]
    if not len(row):
        return
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(first)
    many = np.diff(np.append(head, len(row)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(doc[row[head]]), pa.array(repeats.place(start[head], many, repeats.check_of(at)[row[head]]))], ["doc", "at"]
    )
