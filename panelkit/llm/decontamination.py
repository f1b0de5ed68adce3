"""Benchmark passages in documents, by SimHash over item-sized windows.

A window has as many words as the item. Fingerprints are compared through a
multi-index: 64 bits in more blocks than bits may differ, so two fingerprints
within the radius agree in a block. Candidates are confirmed by the weighted
similarity of their word shingles. Only windows that hold some shingle of the
benchmark are fingerprinted, since no other can be similar to an item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from . import carried, grams
from .bpe import spread
from .columns import free

RADIUS = 20
#: Blocks of three bits, the last of four: one more than the radius.
BLOCKS = [(3 * i, 3) for i in range(RADIUS)] + [(3 * RADIUS, 64 - 3 * RADIUS)]
#: Text of the items that a task holds at once; more items take further passes over the documents.
ITEM_BYTES = 32 << 20


def fingerprints(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` words at ``starts``: the majority of each bit."""
    bits = ((words[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[starts + size] - sums[starts] > 0
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """All fingerprints within the radius of a query, by blocks that agree."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        self.blocks = []
        for shift, width in BLOCKS:
            value = self._block(prints, shift, width)
            order = np.argsort(value, kind="stable")
            self.blocks.append((order, value[order]))

    @staticmethod
    def _block(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, item) whose fingerprints differ in at most ``RADIUS`` bits."""
        keys = []
        for (shift, width), (order, sorted_values) in zip(BLOCKS, self.blocks):
            value = self._block(queries, shift, width)
            low, high = np.searchsorted(sorted_values, value, "left"), np.searchsorted(sorted_values, value, "right")
            query = np.repeat(np.arange(len(queries)), high - low)
            keys.append(np.unique(query * len(self.prints) + order[spread(low, high - low)]))
        pairs = np.unique(np.concatenate(keys))
        query, item = pairs // len(self.prints), pairs % len(self.prints)
        ok = np.bitwise_count(queries[query] ^ self.prints[item]) <= RADIUS
        return query[ok], item[ok]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shingle weights in common over all weights; a shingle weighs as often as it stands there."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class _Items:
    """Word hashes, shingles and fingerprints of a block of items."""

    def __init__(self, ids: list, texts: pa.Array, width: int) -> None:
        self.ids, self.words = [], []
        for piece in grams.pieces(texts):
            hashes, bounds = document_words(piece)
            for i in range(piece.last - piece.first):
                if bounds[i + 1] > bounds[i]:
                    self.ids.append(ids[piece.first + i])
                    self.words.append(hashes[bounds[i] : bounds[i + 1]])
        self.shingles = [shingles(w, min(width, len(w))) for w in self.words]
        self.by_size: dict[int, np.ndarray] = {}
        sizes = np.array([len(w) for w in self.words], np.int64)
        for size in np.unique(sizes):
            self.by_size[int(size)] = np.flatnonzero(sizes == size)
        self.index = {
            size: MultiIndex(np.concatenate([fingerprints(self.words[i], np.zeros(1, np.int64), size) for i in items]))
            for size, items in self.by_size.items()
        }
        self.gates = {}
        for k in {min(width, s) for s in self.by_size}:
            known: dict[int, set[int]] = defaultdict(set)
            for s, w in zip(self.shingles, self.words):
                if min(width, len(w)) == k:
                    for x in s.tolist():
                        known[x].add(len(w))
            found = np.array(sorted(known), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(found >> np.uint64(44)).astype(np.int64)] = True
            self.gates[k] = (found, seen, [sorted(known[x]) for x in found.tolist()])


def document_words(piece: grams.Piece) -> tuple[np.ndarray, np.ndarray]:
    data = grams.LOWER[piece.data]
    lowered = grams.Piece(piece.first, piece.last, data, piece.offsets)
    spans = grams.words(lowered, grams.ALPHANUMERIC)
    return grams.word_hashes(data, spans), spans.bounds


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    return grams.gram_hash(grams.prefix(words), width)


def matches(df: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_id: str = "item_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Documents that hold an item: ``id, item_id, start_word, n_words, similarity`` of its best window.

    Words are runs of letters, digits and characters beyond ASCII; A-Z count as
    a-z. A shingle has ``width`` words, or is the whole item if that is
    shorter. A window matches with ``percent`` of the shingle weights in
    common; of equal windows the first is given. A document shorter than the
    item is compared whole. Items and documents without words match nothing.
    Repeated rows are reported each; a document without id is reported with a
    null id. Other columns are not carried.
    """
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = None
    for block in _blocks(items, item_id):
        found = docs.mapInArrow(_matcher(block, width, percent), SCHEMA)
        out = out.unionByName(found) if out else found
    return out.withColumnRenamed("id", id).withColumnRenamed("item", item_id)


def clean(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, all columns as they are, that ``matches`` finds no item in; one map for each block of items."""
    mark = free(df, "leaks")
    for block in _blocks(items, item_id):
        df = carried.with_columns(df, text, [(mark, T.BooleanType())], _marker(block, width, percent)).where(~F.col(mark)).drop(mark)
    return df


def _blocks(items: DataFrame, item_id: str) -> Iterator[pa.Table]:
    """The items with a text, in blocks of about ``ITEM_BYTES``; at least one."""
    known = items.select(F.col(item_id).cast("long").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // ITEM_BYTES) or 1
    for b in range(blocks):
        yield known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").toArrow()


def _marker(block: pa.Table, width: int, percent: int):
    ids, texts = block.column("item").to_pylist(), block.column("text").combine_chunks()

    def begin() -> carried.Compute:
        items = _Items(ids, texts, width)

        def compute(_: pa.RecordBatch, piece: grams.Piece) -> list[pa.Array]:
            hashes, bounds = document_words(piece)
            out = np.zeros(piece.last - piece.first, bool)
            for row, sizes in _gated(items, hashes, bounds).items():
                out[row] = next(_best(items, hashes[bounds[row] : bounds[row + 1]], sizes, width, percent), None) is not None
            return [pa.array(out)]

        return compute

    return begin


SCHEMA = "id long, item long, start_word long, n_words long, similarity double"


def _matcher(block: pa.Table, width: int, percent: int):
    ids, texts = block.column("item").to_pylist(), block.column("text").combine_chunks()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(ids, texts, width)
        for batch in batches:
            rows: list[tuple] = []
            for piece in grams.pieces(batch.column(1)):
                hashes, bounds = document_words(piece)
                for row, sizes in _gated(items, hashes, bounds).items():
                    doc = batch.column(0)[piece.first + row].as_py()
                    words = hashes[bounds[row] : bounds[row + 1]]
                    rows += [(doc, *found) for found in _best(items, words, sizes, width, percent)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _TYPES)], _NAMES)

    return each


_NAMES = ["id", "item", "start_word", "n_words", "similarity"]
_TYPES = [pa.int64()] * 4 + [pa.float64()]


def _gated(items: _Items, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, set[int]]]:
    """For each row, the item sizes and the places of benchmark shingles."""
    out: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
    sums = grams.prefix(hashes)
    for k, (found, seen, sizes) in items.gates.items():
        g = grams.gram_hash(sums, k)
        at = np.flatnonzero(seen[(g >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(found, g[at])
        hit = place < len(found)
        hit[hit] = found[place[hit]] == g[at[hit]]
        at, place = at[hit], place[hit]
        row = np.searchsorted(bounds, at, "right") - 1
        inside = at + k <= bounds[row + 1]
        for r, p, i in zip(row[inside].tolist(), (at - bounds[row])[inside].tolist(), place[inside].tolist()):
            for size in sizes[i]:
                out[r][size].add(p)
    return out


def _best(items: _Items, words: np.ndarray, sizes: dict[int, set[int]], width: int, percent: int) -> Iterator[tuple]:
    best: dict[int, tuple] = {}
    for size, places in sizes.items():
        k, span = min(width, size), min(size, len(words))
        at = np.array(sorted(places))
        last = len(words) - span
        mark = np.zeros(last + 2, np.int64)
        np.add.at(mark, np.clip(at - (span - k), 0, last), 1)
        np.add.at(mark, np.minimum(at, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        query, item = items.index[size].near(fingerprints(words, starts, span))
        own = shingles(words, k)
        for q, i in zip(query.tolist(), items.by_size[size][item].tolist()):
            start = int(starts[q])
            s = similarity(own[start : start + span - k + 1], items.shingles[i])
            if 100 * s >= percent and (i not in best or (s, -start) > (best[i][3], -best[i][1])):
                best[i] = (items.ids[i], start, span, s)
    for i in sorted(best):
        yield best[i]
