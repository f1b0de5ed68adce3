"""Array helpers for Arrow tasks: words, hashes and content-chosen anchors of whole texts.

A task gets its texts as Arrow batches. ``pieces`` cuts a batch into runs of
whole documents of a few megabytes, so the arrays of a task stay bounded
whatever the batch holds. All hashes are polynomials modulo the prime 2**61 - 1
with a random base, finished with a mixer: unlike arithmetic modulo a power
of two, no structured text makes them meet more often than chance. A slice's
hash costs one subtraction and one product of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_BASE = 1_573_680_962_116_398_497
_INVERSE = pow(_BASE, -1, _PRIME)
#: Elements multiplied at once, so that the steps of a product stay in the processor's cache.
_AT_ONCE = 1 << 14


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for reduced values."""
    low, half, rest = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64((1 << 30) - 1)
    out = np.empty(len(a), np.uint64)
    for i in range(0, len(a), _AT_ONCE):
        x, y = a[i : i + _AT_ONCE], b[i : i + _AT_ONCE]
        xl, xh, yl, yh = x & low, x >> half, y & low, y >> half
        middle = xh * yl
        middle += xl * yh
        total = xh * yh
        total <<= np.uint64(1)
        total += middle >> np.uint64(30)
        middle &= rest
        middle <<= half
        total += middle
        xl *= yl
        total += xl
        out[i : i + _AT_ONCE] = _reduced(total)
    return out


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b modulo the prime, for reduced values."""
    return np.where(a >= b, a - b, a + (_P - b))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = _product(out[:take], np.full(take, step, np.uint64))
        filled, step = filled + take, step * step % _PRIME
    return out


class _Powers:
    """Powers of the base and of its inverse, grown when a longer text needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up, self.down


_TABLES = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i modulo the prime; one longer than the input."""
    up, _ = _TABLES.of(len(values) + 1)
    terms = _product(_reduced(values), up[: len(values)])
    out = np.zeros(len(values) + 1, np.uint64)
    # Sums of halves stay below 2**64 for up to 2**32 values.
    low, high = np.cumsum(terms & np.uint64(0xFFFFFFFF)), _reduced(np.cumsum(terms >> np.uint64(32)))
    # high * 2**32 modulo the prime: its upper 32 bits wrap around to the front.
    high = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29))
    out[1:] = _reduced(_reduced(low) + high)
    return out


def _moved(sums: np.ndarray, start: np.ndarray, down: np.ndarray, length: np.ndarray | np.uint64) -> np.ndarray:
    return mix(_product(_less(sums, start), down) + length)


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of the values in [start, end); equal for equal slices anywhere."""
    _, down = _TABLES.of(len(sums))
    return _moved(sums[end], sums[start], down[start], (end - start).astype(np.uint64) << np.uint64(32))


def gram_hash(sums: np.ndarray, q: int) -> np.ndarray:
    """Hash of every run of ``q`` values, as ``slice_hash`` gives it."""
    n = len(sums) - 1 - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _TABLES.of(len(sums))
    return _moved(sums[q:], sums[:n], down[:n], np.uint64(q << 32))


@dataclass
class Piece:
    """Whole documents of a batch: rows [first, last), their bytes and byte offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts as runs of whole documents of about ``limit`` bytes; null texts are empty."""
    column = texts.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Piece(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SPACE_SEPARATED = ~_SPACE
#: Letters, digits and everything beyond ASCII.
ALPHANUMERIC = np.array([b > 0x7F or chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Word spans of a piece: byte starts and ends, the owning row, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # word index where each row begins; one more at the end

    def __len__(self) -> int:
        return len(self.starts)


def words(piece: Piece, member: np.ndarray = SPACE_SEPARATED) -> Words:
    """Maximal runs of member bytes inside each document."""
    if not len(piece.data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(piece.offsets), np.int64))
    inside = member[piece.data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = piece.offsets[1:-1]
    cut = cut[cut < len(piece.data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(starts, ends, np.searchsorted(starts, piece.offsets))


def word_hashes(data: np.ndarray, spans: Words) -> np.ndarray:
    return slice_hash(prefix(BYTE_VALUES[data]), spans.starts, spans.ends)


def runs_inside(bounds: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask over starts 0 .. total-length: does the run of ``length`` stay in one document?"""
    n = max(total - length + 1, 0)
    ok = np.ones(n, bool)
    if length > 1 and n:
        mark = np.zeros(total + 1, np.int32)
        inner = bounds[1:-1]
        np.add.at(mark, np.maximum(inner - length + 1, 0), 1)
        np.add.at(mark, inner, -1)
        ok &= np.cumsum(mark)[:n] == 0
    return ok


@dataclass
class Segments:
    """Runs of window starts that chose the same anchor: first start, number, anchor hash, span hash."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    span: np.ndarray


_INDEX_BITS = 24
#: Longer texts are cut into overlapping parts; every window start lies in one part.
PART = 1 << 22


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(sums: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Segments:
    """Anchors of all windows of ``window`` values inside documents.

    Each window chooses its smallest gram hash, the leftmost of equal ones, so
    equal windows choose the same gram at the same place wherever they stand.
    """
    total = len(sums) - 1
    found = [_part(sums, bounds, window, gram, at, min(at + PART, total - window + 1)) for at in range(0, max(total - window + 1, 0), PART)]
    if not found:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Segments(*(np.concatenate(x) for x in zip(*found)))


def _part(sums, bounds, window, gram, low, high):
    size = high - low + window - 1
    local = sums[low : low + size + 1]
    _, down = _TABLES.of(len(sums))
    grams = _moved(local[gram:], local[: size - gram + 1], down[low : low + size - gram + 1], np.uint64(gram << 32))
    order = (grams >> np.uint64(_INDEX_BITS)) << np.uint64(_INDEX_BITS) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(order, window - gram + 1) & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    ok = _inside(bounds, window, low, high)
    new = np.ones(high - low, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (ok[1:] != ok[:-1])
    # Equal anchors of two documents cannot meet: windows that cross a border lie between them.
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, high - low))
    keep = ok[start]
    start, count = start[keep], count[keep]
    at = start + low
    return at, count, grams[chosen[start]], slice_hash(sums, at, at + count - 1 + window)


def _inside(bounds, window, low, high):
    ok = np.zeros(high - low + 1, np.int32)
    first = np.clip(bounds[:-1] - low, 0, high - low)
    last = np.clip(np.maximum(bounds[1:] - window + 1, bounds[:-1]) - low, 0, high - low)
    np.add.at(ok, first, 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok)[:-1] > 0
