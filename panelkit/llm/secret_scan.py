"""Secrets in texts, as DataFrame expressions.

Known forms are found by pattern. Further secrets are long strings whose
Shannon entropy is high for their character class somewhere: a window slides
over the candidate, and each step updates the sum of ``n log2 n`` with the
counts of the character that leaves and the one that enters. A candidate is
judged whole and by its runs of letters and digits, each by the alphabet it is
written in; what a known form or a date in front takes is cut off first, and
what remains is a candidate of its own. An allow-list suppresses identifiers
that look random and are not secret. Work grows in proportion to the text: the window's
counts are kept in the fold's state, spans get their places from running sums
over blocks, and texts are cut by blocks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import free

KINDS = ("assign", "access", "hex", "entropy")
#: The base patterns. A run too short for its kind is no match.
_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"
_HEX = r"[0-9a-f]{24,}"
_LEAST_VALUE = 6
WINDOW = 20
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets, narrowest first, and the bits a character that a window must reach: 95 % of random
#: strings of ``WINDOW`` characters do (hexadecimal: 97 %). A string in none counts as base64.
CLASSES = (
    ("[0-9]+", 2.64),
    ("[0-9A-Fa-f]+", 3.0),
    ("[a-z]+|[A-Z]+", 3.38),
    ("[a-z2-7]+|[A-Z2-7]+", 3.48),
    ("[a-z0-9]+|[A-Z0-9]+", 3.54),
    ("[A-Za-z]+", 3.68),
)
BASE64_BITS = 3.78
#: A date, or date and time, in front of a candidate; the rest is judged without it.
_DATE = r"(?<![A-Za-z0-9+/_=-])[/_=+-]*[0-9]{4}-[0-9]{2}-[0-9]{2}([T_-]?[0-9]{2}-?[0-9]{2}(-?[0-9]{2}(-?[0-9]{3,6})?)?Z?(?![A-Za-z0-9]))?"
#: Candidates that are no secrets: UUIDs, paths of plain words, one repeated character.
ALLOW = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    # Possessive: the expression engine would go one call deeper for each repetition of a group.
    r"/?(?:[a-z]{1,19}+[/_-])++[a-z]{0,19}[0-9]{0,4}",
    r"(.)\1+",
)


_SPANS = "array<struct<s: int, k: int, e: int>>"
_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
#: Counts of a window in five bits each, twelve to a long.
_BITS, _PACKED = 5, 12
#: ``n log2 n`` as integers, so that a sum that goes up and down stays exact.
_UNIT = 1 << 32
_WEIGHTS = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 1)]
#: Elements folded one after another; a longer list is folded by blocks.
_BLOCK = 256
#: Characters of a block that texts are cut by.
_TEXT_BLOCK = 4096


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over all values up to each one, for a list that is not empty; ``op`` leaves a value alone with 0."""
    blocks = F.transform(F.sequence(F.lit(0), _div(F.size(values) - 1, _BLOCK)), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    last = lambda s: F.element_at(s, -1)
    inside = F.transform(blocks, lambda x: F.slice(F.aggregate(x, F.array(F.lit(0)), lambda s, v: F.array_append(s, op(last(s), v))), 2, _BLOCK))
    before = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda s, y: F.array_append(s, op(last(s), last(y))))
    return _let(inside, lambda x: _let(before(x), lambda n: F.flatten(F.transform(x, lambda y, b: F.transform(y, lambda v: op(F.get(n, b), v))))))


def _spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of all matches, leftmost first; ``keep`` judges the match or its group."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    none = F.array().cast(_SPANS)

    def placed(x: Column) -> Column:
        ends = _running(F.transform(x["m"], lambda m, i: F.length(m) + F.length(F.get(x["p"], i))), lambda a, b: a + b)
        span = lambda m, e: F.struct((e - F.length(m)).alias("s"), F.lit(kind).alias("k"), e.alias("e"))
        all = _let(ends, lambda e: F.transform(x["m"], lambda m, i: span(m, F.get(e, i))))
        kept = F.filter(F.transform(x["v"], lambda v, i: F.when(keep(v), i)), lambda i: i.isNotNull()) if keep else None
        return all if kept is None else _let(all, lambda y: F.transform(kept, lambda i: F.get(y, i)))

    parts = F.struct(found(0).alias("m"), F.split(text, pattern, -1).alias("p"), found(group).alias("v"))
    return F.when(text.rlike(pattern), _let(parts, placed).cast(_SPANS)).otherwise(none)


def _entropy(c: Column) -> Column:
    """The highest entropy of any window of the string ``c``, in bits a character."""
    codes = F.transform(F.filter(F.split(c, ""), lambda y: y != ""), lambda y: F.instr(F.lit(_ALPHABET), y) - 1)
    weights = F.lit(_WEIGHTS).cast("array<bigint>")
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x % _PACKED * _BITS)
    count = lambda n, x: F.call_function("shiftright", F.get(n, _div(x, _PACKED)), x % _PACKED * _BITS).bitwiseAND(F.lit(31)).cast("int")
    moved = lambda n, x, sign: F.transform(n, lambda v, k: F.when(k == _div(x, _PACKED), v + sign * one(x)).otherwise(v))
    state = lambda n, total, least: F.struct(n.alias("n"), total.alias("sum"), least.alias("least"))
    change = lambda n: F.get(weights, n) - F.get(weights, n - 1)

    def step(b: Column, i: Column, list: Column) -> Column:
        gone = F.get(list, i - WINDOW)
        left = F.when(i < WINDOW, b).otherwise(state(moved(b["n"], gone, -1), b["sum"] - change(count(b["n"], gone)), b["least"]))

        def entered(b: Column) -> Column:
            new = F.get(list, i)
            total = b["sum"] + change(count(b["n"], new) + 1)
            return _let(total, lambda t: state(moved(b["n"], new, 1), t, F.when(i < WINDOW - 1, b["least"]).otherwise(F.least(b["least"], t))))

        return _let(left, entered)

    words = -(-len(_ALPHABET) // _PACKED)
    start = state(F.lit([0] * words).cast("array<bigint>"), F.lit(0).cast("bigint"), F.lit(1 << 62).cast("bigint"))
    least = _let(codes, lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, lambda b, i: step(b, i, x), lambda b: b["least"]))
    return F.lit(math.log2(WINDOW)) - least / F.lit(float(WINDOW * _UNIT))


def _without(text: Column, spans: Column, shown: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``shown(span, end of the spans before)`` in place of each span; spans come by start and may overlap."""
    at = lambda i: i * _TEXT_BLOCK

    def part(blocks: Column, s: Column, e: Column) -> Column:
        piece = lambda b: F.get(blocks, b).substr(F.greatest(s - at(b), F.lit(0)) + 1, F.least(e - at(b), F.lit(_TEXT_BLOCK)) - F.greatest(s - at(b), F.lit(0)))
        return F.when(e > s, F.array_join(F.transform(F.sequence(_div(s, _TEXT_BLOCK), _div(e - 1, _TEXT_BLOCK)), piece), "")).otherwise("")

    def joined(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["reach"], i - 1)).otherwise(0)
        parts = F.transform(x["spans"], lambda y, i: F.concat(part(x["blocks"], before(i), y["s"]), shown(y, before(i))))
        return F.concat(F.array_join(parts, ""), part(x["blocks"], F.element_at(x["reach"], -1), F.length(text)))

    reach = _running(F.transform(spans, lambda y: y["e"]), F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_TEXT_BLOCK}}}"), F.lit(0))
    parts = F.struct(spans.alias("spans"), reach.alias("reach"), blocks.alias("blocks"))
    return F.when(F.size(spans) > 0, _let(parts, joined)).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with a space for each character of the spans."""
    return _without(text, spans, lambda y, before: F.repeat(F.lit(" "), F.greatest(y["e"] - F.greatest(before, y["s"]), F.lit(0))))


def scan(df: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW, spans: str = "secrets") -> DataFrame:
    """``df`` with ``secrets``, or another column ``spans``: spans of secrets as (s, k, e), by start, then kind.

    ``s`` and ``e`` count code points, end exclusive; ``k`` is the place in
    ``KINDS``. Entropy spans never overlap the spans of known forms: a
    candidate is cut at them, and each rest of 20 and more characters is judged
    on its own. Keys in groups of less than 20 letters and digits are judged as
    base64 only. Null and empty texts have none. All columns are kept; a column
    of that name is replaced. Rows are judged one by one, so ids need not be
    unique; an empty table gives no rows.
    """
    whole = lambda c, p: c.rlike(f"^({p})$")

    def bits(c: Column) -> Column:
        out = F
        for pattern, b in CLASSES:
            out = out.when(whole(c, pattern), b)
        return out.otherwise(BASE64_BITS)

    def high(v: Column) -> Column:
        allowed = F.lit(False)
        for pattern in allow:
            allowed = allowed | whole(v, pattern)
        runs = F.filter(F.split(v, "[+/_=-]+"), lambda r: (F.length(r) >= WINDOW) & (F.length(r) < F.length(v)))
        return F.when(allowed, False).when(_entropy(v) >= bits(v), True).otherwise(F.exists(runs, lambda r: _entropy(r) >= bits(r)))

    names = [free(df, f"secret_{n}") for n in ("text", "base", "left", "dates", "more")]
    t, base, left, dates, more = map(F.col, names)
    out = df.withColumn(names[0], F.coalesce(F.col(text).cast("string"), F.lit("")))
    known = [_spans(t, _ASSIGN, 0, lambda v: F.length(v) >= _LEAST_VALUE, 2), _spans(t, _ACCESS, 1), _spans(t, _HEX, 2)]
    out = out.withColumn(names[1], F.array_sort(F.concat(*known))).withColumn(names[2], _blanked(t, base))
    out = out.withColumn(names[3], _spans(left, _DATE, 3)).withColumn(names[2], _blanked(left, dates))
    out = out.withColumn(names[4], _spans(left, _CANDIDATE, 3, high))
    return out.withColumn(spans, F.array_sort(F.concat(base, more))).drop(*names)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", spans: str = "secrets") -> DataFrame:
    """``df`` with the spans of ``secrets``, or of ``spans``, in the text replaced by a mask; overlapping spans become one."""
    return df.withColumn(text, _without(F.col(text), F.col(spans), lambda y, before: F.when(y["s"] >= before, F.lit(mask)).otherwise("")))
