"""Maximal periodic runs of words, found by minimizers at several scales.

A run repeats its own words at the distance of its period. Periods below
``DIRECT`` are found by comparing the text with itself at each such lag. For
longer ones, scale ``t`` is in charge of periods from ``2t`` to ``4t``: every
window of ``t + 1`` grams of ``t`` words marks its smallest gram, and as a run's
windows come again one period later, so do their marks. Pairs of equal marks
at a distance that the scale is in charge of are seeds, extended both ways by
comparing words.

Grams that lie inside a run of a period up to ``t / 3`` are never marked, else a text
of one repeated word would mark every place. A longer run can still consist of
such stretches: one period ends where a short run ends and another with the same
period begins. There the phase of the two short runs gives the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams

#: Periods below this are compared lag by lag; twice the smallest scale.
DIRECT = 32
#: Fixed value: the shortest run.
LEAST = 12


@dataclass
class Runs:
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def _least(period: np.ndarray, least: int) -> np.ndarray:
    return np.maximum(least, 2 * period)


def _lag(w: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of period ``p`` that are long enough."""
    same = np.flatnonzero(w[p:] == w[:-p])
    if not len(same):
        return same, same
    cut = np.flatnonzero(np.diff(same) > 1)
    first = same[np.concatenate([[0], cut + 1])]
    length = same[np.concatenate([cut, [len(same) - 1]])] - first + 1 + p
    ok = length >= max(least, 2 * p)
    return first[ok], length[ok]


def _same_ahead(w: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` on, a < b."""
    n, step = 0, 64
    while b + n < len(w):
        take = min(step, len(w) - b - n)
        same = w[a + n : a + n + take] == w[b + n : b + n + take]
        if not same.all():
            return n + int(np.argmin(same))
        n, step = n + take, step * 2
    return n


def _same_behind(w: np.ndarray, a: int, b: int) -> int:
    """How many words before ``a`` equal those before ``b``, a < b."""
    n, step = 0, 64
    while a - n > 0:
        take = min(step, a - n)
        same = w[a - n - take : a - n] == w[b - n - take : b - n]
        if not same.all():
            return n + int(np.argmin(same[::-1]))
        n, step = n + take, step * 2
    return n


def _extended(w: np.ndarray, at: np.ndarray, period: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Runs around the seeds: the word at ``at`` and the one a period later."""
    out, last, reached = [], -1, -1
    for k in np.lexsort((at, period)):
        i, p = int(at[k]), int(period[k])
        if p != last:
            last, reached = p, -1
        if i < reached or w[i] != w[i + p]:
            continue
        before = _same_behind(w, i, i + p)
        after = _same_ahead(w, i, i + p)
        reached = i + after
        if before + after + p >= max(least, 2 * p):
            out.append((i - before, before + after + p, p))
    return out


def _marks(w: np.ndarray, values: np.ndarray, t: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Marked places of scale ``t`` and their gram hashes. ``w`` is negative between texts."""
    hashes = grams.gram_hash(grams.prefix(values), t)
    blocked = np.zeros(len(w) + 1, np.int32)
    border = np.flatnonzero(w < 0)
    np.add.at(blocked, np.maximum(border - t + 1, 0), 1)
    np.add.at(blocked, border + 1, -1)
    short = (3 * runs.period <= t) & (runs.length >= t)
    np.add.at(blocked, runs.start[short], 1)
    np.add.at(blocked, runs.start[short] + runs.length[short] - t + 1, -1)
    free = np.cumsum(blocked)[: len(hashes)] == 0
    bits = np.uint64(max(len(w).bit_length(), 24))
    top = np.uint64((1 << 64) - 1) << bits
    order = np.where(free, hashes & top, top) | np.arange(len(hashes), dtype=np.uint64)
    if len(order) <= t:
        chosen = np.zeros(0, np.int64)
    else:
        chosen = (grams._sliding_min(order, t + 1) & ~top).astype(np.int64)
        chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
        chosen = chosen[free[chosen]]
    return chosen, hashes[chosen]


def _pairs(place: np.ndarray, hashes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal marks at a distance from 2t to 4t: the first place and the distance."""
    order = np.argsort(hashes, kind="stable")
    place, hashes = place[order], hashes[order]
    at, gap, k = [], [], 1
    left = np.arange(len(place))
    while True:
        left = left[left + k < len(place)]
        d = place[left + k] - place[left]
        near = (hashes[left + k] == hashes[left]) & (d < 4 * t)
        left, d = left[near], d[near]
        if not len(left):
            break
        hit = d >= 2 * t
        at.append(place[left[hit]])
        gap.append(d[hit])
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *gap])


def _junctions(w: np.ndarray, t: int, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Seeds where a run of a short period meets another of the same period."""
    keep = np.flatnonzero((3 * runs.period <= t) & (runs.length >= 2 * t))
    keep = keep[np.lexsort((runs.start[keep], runs.period[keep]))]
    at, gap = [], []
    for a, b in zip(keep[:-1], keep[1:]):
        q, end = int(runs.period[a]), int(runs.start[a] + runs.length[a])
        if runs.period[b] != q or not 0 <= end - runs.start[b] < q:
            continue
        near = w[end - 2 * q : end + q]
        hashes = grams.gram_hash(grams.prefix(grams.mix(near.astype(np.uint64))), q)
        shift = next((r for r in np.flatnonzero(hashes[:q] == hashes[-1]) if (near[r : r + q] == near[2 * q :]).all()), None)
        if shift is None:
            continue
        most = min(4 * t - 1, min(runs.length[a], runs.length[b]) + q)
        p = np.arange(2 * t + (-int(shift) - 2 * t) % q, most + 1, q)
        p = p[end - p >= runs.start[a]]
        at.append(end - p)
        gap.append(p)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *gap])


def find(w: np.ndarray, bounds: np.ndarray, least: int = LEAST, direct: int = DIRECT) -> Runs:
    """All runs of the texts ``w[bounds[k]:bounds[k+1]]``, by start and period; numbers of words are not negative.

    ``direct`` is twice the smallest scale, which must be at least ``least``
    so that every short run that hides a gram is known.
    """
    sizes = np.diff(bounds)
    # A number of its own after each text: nothing equals it, so no run crosses.
    text = np.repeat(np.arange(len(sizes)), sizes)
    spaced = np.full(len(w) + len(sizes), -1, np.int64)
    spaced[np.arange(len(w)) + text] = w
    spaced[bounds[1:] + np.arange(len(sizes))] = -1 - np.arange(len(sizes))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    for p in range(1, min(direct, int(sizes.max(initial=0)) // 2 + 1)):
        start, length = _lag(spaced, p, least)
        found.append((start, length, np.full(len(start), p)))
    runs = _smallest(found)
    t, values = direct // 2, grams.mix(spaced.astype(np.uint64) + np.uint64(1 << 40))
    origin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    while 4 * t <= sizes.max(initial=0):
        # Texts that can hold two periods of this scale.
        own = np.flatnonzero(sizes >= 4 * t)
        place = np.concatenate([np.arange(origin[k], origin[k] + sizes[k] + 1) for k in own])
        moved = np.full(len(spaced), -1, np.int64)
        moved[place] = np.arange(len(place))
        inside = moved[runs.start] >= 0
        local = Runs(moved[runs.start[inside]], runs.length[inside], runs.period[inside])
        part = spaced[place]
        seeds = [_pairs(*_marks(part, values[place], t, local), t), _junctions(part, t, local)]
        new = _extended(part, *(np.concatenate(x) for x in zip(*seeds)), least)
        if new:
            start, length, period = (np.array(x, np.int64) for x in zip(*new))
            runs = _smallest([(runs.start, runs.length, runs.period), (place[start], length, period)])
        t *= 2
    # Places without the numbers between the texts.
    row = np.searchsorted(origin, runs.start, "right") - 1
    return Runs(runs.start - row, runs.length, runs.period)


def _smallest(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Runs:
    """One run of each place and length: a stretch also repeats at multiples of its period."""
    start, length, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def word_numbers(piece: grams.Piece, spans: grams.Words) -> np.ndarray:
    """A number for each word, the same for equal words only: they are compared byte by byte."""
    inside = grams.SPACE_SEPARATED[piece.data]
    ends = np.concatenate([[0], np.cumsum(spans.ends - spans.starts)]).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(piece.data[inside].tobytes())])
    return raw.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def joined(data: np.ndarray, spans: grams.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    start, size = spans.starts[keep], (spans.ends - spans.starts)[keep] + 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.concatenate([data, [0]]).astype(np.uint8)[np.arange(total) + np.repeat(start - ends + size, size)]
    out[ends - 1] = 32
    count = np.concatenate([[0], np.cumsum(keep)])[spans.bounds]
    bounds = np.concatenate([[0], ends])[count]
    full = np.flatnonzero(np.diff(bounds))
    out = np.delete(out, bounds[full + 1] - 1)
    trimmed = np.zeros(len(bounds), np.int64)
    trimmed[full + 1] = 1
    bounds = (bounds - np.cumsum(trimmed)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])


def runs(df: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """``id, n_words, runs, collapsed`` of every row.

    ``runs`` holds ``start, length, period`` in words of every maximal run of
    at least ``least`` words and two periods, by start and period. In
    ``collapsed`` each run keeps its first period only; words are joined by
    one space. Null and blank texts have no words and collapse to nothing. Texts
    are taken whole and row by row, so repeated rows and null ids stay as they
    are; an empty table gives no rows; other columns are not carried.
    """
    names = ["id", "n_words", "runs", "collapsed"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                spans = grams.words(piece)
                found = find(word_numbers(piece, spans), spans.bounds, least)
                row = np.searchsorted(spans.bounds, found.start, "right") - 1
                edge = np.zeros(len(spans) + 1, np.int64)
                np.add.at(edge, found.start + found.period, 1)
                np.add.at(edge, found.start + found.length, -1)
                fields = [found.start - spans.bounds[row], found.length, found.period]
                items = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields], ["start", "length", "period"])
                offsets = np.searchsorted(row, np.arange(len(piece.offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[piece.first : piece.last], pa.array(np.diff(spans.bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), items), joined(piece.data, spans, np.cumsum(edge)[:-1] == 0).cast(pa.string()),
                    ],
                    names,
                )

    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(each, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id)
