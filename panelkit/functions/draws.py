"""Keyed draws: every random choice is a hash of (seed, keys).

A draw depends only on the row it belongs to, so it survives retries,
repartitioning and a change of engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw_key(seed: object, *keys: Column | str) -> Column:
    """32 hex digits, uniform over the keys; the text to order or cut by."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def key_text(*keys: Column | str) -> Column:
    """The keys joined as ``draw_key`` joins them; in their place it gives the same draws, and is built once a row."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(":", *parts))


def draw_int(seed: object, *keys: Column | str) -> Column:
    """Uniform integer in [0, 2**48)."""
    return _draw_of(draw_key(seed, *keys))


def _draw_of(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint")


def share_limit(share: float) -> str:
    """Hex text below which ``share`` of the keys fall (8 digits)."""
    return format(int(share * 2**32), "08x")


def draw_below(seed: object, share: float, *keys: Column | str) -> Column:
    """True for about ``share`` of the keys."""
    if share >= 1:
        return F.lit(True)
    return F.substring(draw_key(seed, *keys), 1, 8) < F.lit(share_limit(share))


# Rounds of the position permutation, and turns walked before the long walk.
ROUNDS = 6
SHORT_WALK = 8


def distinct_draws(m: Column, n: int, seed: object, *keys: Column | str) -> Column:
    """``n`` different positions out of 0..m-1, in draw order, inside the row.

    Positions 0..n-1 go through a keyed permutation of 0..m-1, so they differ
    whatever the hashes are and the cost is O(n) for any ``m``. The permutation
    is a Feistel network over pairs (left, right) of an a x b grid with
    a = ceil(sqrt(m)); a pair beyond m is sent through it again until it falls
    below m. Fewer than a pairs lie beyond, so a walk of a turns always ends.
    Fewer than ``n`` positions is an error.
    """
    m = m.cast("bigint")
    a = F.ceil(F.sqrt(m)).cast("bigint")
    b = _whole(m + a - 1, a)

    def turn(x: Column) -> Column:
        def mixed(s: Column, i: Column) -> Column:
            left = (s["l"] + F.pmod(draw_int(seed, *keys, i, s["r"]), a)) % a
            right = (s["r"] + F.pmod(draw_int(seed, *keys, i, s["l"]), b)) % b
            return F.when(i % 2 == 0, _pair(left, s["r"])).otherwise(_pair(s["l"], right))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _pair(_whole(x, b), x % b), mixed,
            lambda s: s["l"] * b + s["r"],
        )

    def walk(x: Column, turns: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1).cast("bigint"), turns), x,
            lambda y, _: F.when(y >= m, turn(y)).otherwise(y),
        )

    starts = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    near = F.transform(starts, lambda j: walk(turn(j), F.lit(SHORT_WALK).cast("bigint")))
    picks = F.transform(near, lambda x: F.when(x >= m, walk(x, a)).otherwise(x))
    short = F.raise_error(F.concat(F.lit(f"cannot draw {n} rows out of "), m.cast("string")))
    return F.when(m < n, short.cast("array<bigint>")).otherwise(picks)


def _whole(x: Column, by: Column) -> Column:
    """Integer quotient, exact below 2**53."""
    return ((x - x % by) / by).cast("bigint")


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("l"), right.alias("r"))


# As many positions fit the bits of one number.
MASK_BITS = 63


def distinct_positions(m: Column, k: Column, seed: object, *keys: Column | str) -> Column:
    """A set of ``k`` different positions out of 0..m-1, every set alike (Floyd), in ascending order.

    One draw for each picked position, whatever ``m`` is: the draw below j + 1
    for j = m-k..m-1, and j itself if that position is taken. Up to
    ``MASK_BITS`` positions the set is one number, with a bit for each; beyond,
    it is a list that is searched for each draw, as ``k`` is small. ``k`` must
    not exceed ``m``.
    """
    m, k = m.cast("bigint"), k.cast("bigint")
    steps = F.sequence(m - k, m - 1)

    def below(start: Column, j: Column) -> Column:
        # The draw of (seed, keys, j), whose text begins alike for every j.
        return F.pmod(_draw_of(F.md5(F.concat(start, F.lit(":"), j.cast("string")))), j + 1)

    def marked(start: Column) -> Column:
        bits = F.transform(steps, lambda j: F.struct(_bit(j).alias("j"), _bit(below(start, j)).alias("t")))
        return F.aggregate(
            bits, F.lit(0).cast("bigint"),
            lambda s, d: s.bitwiseOR(F.when(s.bitwiseAND(d["t"]) != 0, d["j"]).otherwise(d["t"])),
            lambda s: F.filter(F.sequence(F.lit(0).cast("bigint"), m - 1), lambda p: s.bitwiseAND(_bit(p)) != 0),
        )

    def listed(start: Column) -> Column:
        drawn = F.transform(steps, lambda j: F.struct(j.alias("j"), below(start, j).alias("t")))
        picks = F.aggregate(
            drawn, none,
            lambda s, d: F.concat(
                s, F.array(F.when(F.array_contains(s, d["t"]), d["j"]).otherwise(d["t"]))
            ),
        )
        return F.sort_array(picks)

    none = F.array().cast("array<bigint>")
    # Bound to a variable, the beginning is built once a row.
    start = F.array(F.concat_ws(":", F.lit(str(seed)), *[as_column(c).cast("string") for c in keys]))
    picks = F.get(F.transform(start, lambda s: F.when(m <= MASK_BITS, marked(s)).otherwise(listed(s))), F.lit(0))
    return F.when(k > 0, picks).otherwise(none)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.cast("int"))
