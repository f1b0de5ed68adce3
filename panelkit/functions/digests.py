"""The keyed draws of ``draws`` for whole Arrow batches: MD5 of many short texts at once.

A digest is 64 steps on 32-bit words. Done with arrays, a step serves all texts
of a piece, and no text needs a call of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are digested together; their words stay in the cache.
PIECE = 1 << 15
#: The longest text that fits one block of MD5.
BLOCK_BYTES = 55

_TURNS = [s for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in row * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_SCRATCH = np.empty((6, PIECE), dtype=np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def joined(parts: Sequence[object]) -> pa.Array:
    """Texts joined by ``:`` without the null parts, as ``concat_ws`` does."""
    return pc.binary_join_element_wise(*parts, ":", null_handling="skip")


def draws_of(starts: pa.Array, row: np.ndarray | None = None, number: np.ndarray | None = None) -> np.ndarray:
    """The draws, below 2**48, of the texts ``starts[row]``; with ``number``, of ``starts[row]:number``."""
    starts = starts.cast(pa.large_binary())
    offsets = np.frombuffer(starts.buffers()[1], dtype=np.int64)[starts.offset : starts.offset + len(starts) + 1]
    data = np.frombuffer(starts.buffers()[2] or b"", dtype=np.uint8)
    length = np.diff(offsets)
    row = np.arange(len(starts)) if row is None else row
    out = np.empty(len(row), dtype=np.int64)
    if not len(row):
        return out
    digits = np.zeros(len(row), dtype=np.int64)
    if number is not None:
        digits = np.searchsorted(10 ** np.arange(1, 19), number, side="right") + 1
    # Texts of one length, with numbers of one length, have their bytes at the same places.
    kind = length[row] * 32 + digits
    for k in np.flatnonzero(np.bincount(kind)):
        at = np.flatnonzero(kind == k)
        n_bytes, n_digits = divmod(int(k), 32)
        for i in range(0, len(at), PIECE):
            own = at[i : i + PIECE]
            texts = data[offsets[row[own]][:, None] + np.arange(n_bytes)]
            out[own] = _drawn(texts, None if number is None else number[own], n_digits)
    return out


def _drawn(texts: np.ndarray, number: np.ndarray | None, digits: int) -> np.ndarray:
    n, size = texts.shape
    if size + (digits + 1 if digits else 0) > BLOCK_BYTES:
        tails = [b""] * n if number is None else [b":%d" % i for i in number.tolist()]
        return np.array([int.from_bytes(hashlib.md5(t.tobytes() + e).digest()[:6]) for t, e in zip(texts, tails)], dtype=np.int64)
    block = np.zeros((n, 64), dtype=np.uint8)
    block[:, :size] = texts
    if digits:
        block[:, size] = ord(":")
        rest = number
        for place in range(size + digits, size, -1):
            rest, digit = np.divmod(rest, 10)
            block[:, place] = digit + ord("0")
        size += digits + 1
    block[:, size] = 0x80
    block[:, 56:58] = np.frombuffer((size * 8).to_bytes(2, "little"), dtype=np.uint8)
    # Words behind the text are the same in every row.
    words = [*np.ascontiguousarray(block.view("<u4")[:, : size // 4 + 1].T), *[None] * (15 - size // 4)]
    a, b = _digest(words, n, size * 8)
    return (a.byteswap().astype(np.int64) << 16) | (b.byteswap() >> np.uint32(16)).astype(np.int64)


def _digest(words: list, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests."""
    # The same memory serves every piece of a task.
    a, b, c, d, f, t = (s[:n] for s in _SCRATCH)
    for s, v in zip((a, b, c, d), _START):
        s.fill(v)
    for i, (turn, sine, w) in enumerate(zip(_TURNS, _SINES, _WORDS)):
        if i < 16:
            np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if words[w] is not None:
            np.add(f, words[w], out=f)
        elif w == 14:
            sine = (sine + bits) & 0xFFFFFFFF
        np.add(f, np.uint32(sine), out=f)
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # The place of the old a is free for the next step.
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def below(draw: np.ndarray, share: float) -> np.ndarray:
    """``draws.draw_below`` of draws: true for about ``share`` of them."""
    return draw >> 16 < int(share * 2**32)


def mark_subsets(chosen: np.ndarray, n: np.ndarray, size: np.ndarray, starts: pa.Array, place_of: np.ndarray, owner: np.ndarray) -> None:
    """Mark ``size`` different places out of the first ``n`` of ``place_of[owner]`` in each row of ``chosen``, every set alike (Floyd).

    One draw for each place, whatever ``n`` is: the draw below j + 1 for
    j = n - size .. n - 1, and j itself if that place is taken.
    """
    row = np.repeat(np.arange(len(n)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    j = (n - size)[row] + step
    drawn = draws_of(starts, row, j) % (j + 1)
    order = np.argsort(step.astype(np.int32), kind="stable")
    for own in np.split(order, np.cumsum(np.bincount(step))[:-1]) if len(row) else ():
        r = row[own]
        t = place_of[owner[r], drawn[own]]
        chosen[r, np.where(chosen[r, t], place_of[owner[r], j[own]], t)] = True
