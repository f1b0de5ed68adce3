"""Licences named in texts: notice phrases and identifier tags.

An Aho-Corasick automaton finds all phrases in one pass over the words of a
text, and all identifier tags in one pass over its characters. The expression
behind a tag is ordered by the shunting-yard rule and evaluated to its choices:
``and`` joins, ``or`` offers, ``with`` adds an exception to one licence. Its
labels are the union of its operands, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, product
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are reported, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases that add a label and count in the score; their places are not reported.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx-license-identifier:", "license-identifier:")
#: Weight of one kind of evidence in the score.
PHRASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9

#: Licences that the choices of one expression may list when ``and`` multiplies over ``or``.
MOST_LISTED = 1 << 16

# Bytes outside words become spaces; A-Z become a-z.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+-]*")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def _complete(expression: str) -> list[str]:
    """The tokens up to the last place where the expression is complete."""
    tokens = _TOKEN.findall(expression)
    depth, operand, complete = 0, True, 0
    for i, t in enumerate(tokens):
        if operand and t == "(":
            depth += 1
        elif operand and t not in _STRENGTH and t != ")":
            operand = False
        elif not operand and t == ")" and depth:
            depth -= 1
        elif not operand and t in _STRENGTH and not (t == "with" and tokens[i - 1] == ")"):
            operand = True
            if t == "with" and (i + 1 == len(tokens) or tokens[i + 1] in _STRENGTH or tokens[i + 1] in "()"):
                break
        else:
            break
        if not operand and not depth:
            complete = i + 1
    return tokens[:complete]


def _operands(tokens: list[str]) -> list[str]:
    """Tokens with each licence and its exceptions as one."""
    out: list[str] = []
    after = False
    for t in tokens:
        if after:
            out[-1] = f"{out[-1]} with {t}"
        elif t != "with":
            out.append(t)
        after = t == "with"
    return out


def _choices(tokens: list[str], most: int | None) -> list[frozenset[str]] | None:
    """The choices of a complete expression; None if a product would list more than ``most`` licences."""
    output: list[tuple[str, list[list[frozenset[str]]]]] = []  # an operator and what it combines
    waiting: list[str] = []

    def value(item: tuple[str, list[list[frozenset[str]]]]) -> list[frozenset[str]] | None:
        op, parts = item
        if len(parts) == 1:
            return parts[0]
        if op == "or":
            return list(dict.fromkeys(chain.from_iterable(parts)))
        size = prod(len(p) for p in parts)
        if most is not None and size > 1 and size * sum(max(map(len, p)) for p in parts) > most:
            return None
        common = frozenset(chain.from_iterable(p[0] for p in parts if len(p) == 1))
        return list(dict.fromkeys(common.union(*some) for some in product(*(p for p in parts if len(p) > 1))))

    def reduce() -> bool:
        op, right, left = waiting.pop(), output.pop(), output.pop()
        parts: list[list[frozenset[str]]] = []
        for side in (left, right):
            if side[0] == op:
                more = side[1]
            elif (one := value(side)) is None:
                return False
            else:
                more = [one]
            if parts:
                parts.extend(more)
            else:
                parts = more
        output.append((op, parts))
        return True

    for t in _operands(tokens):
        if t == "(":
            waiting.append(t)
        elif t == ")":
            while waiting[-1] != "(":
                if not reduce():
                    return None
            waiting.pop()
        elif t in _STRENGTH:
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[t]:
                if not reduce():
                    return None
            waiting.append(t)
        else:
            output.append(("", [[frozenset([t])]]))
    while waiting:
        if not reduce():
            return None
    return value(output[0]) if output else []


def choices(expression: str) -> list[frozenset[str]]:
    """The sets of licences that satisfy an expression, in the order they are offered.

    A malformed tail is dropped at the last place where the expression is
    complete; an expression that starts malformed has no choice. All sets are
    made, however many.
    """
    return _choices(_complete(expression), None) or []


def named(expression: str) -> tuple[set[str], list[str]]:
    """The licences of an expression, and its choices as texts.

    Where ``and`` over ``or`` would list more than ``MOST_LISTED`` licences the
    expression itself, in one form of writing, stands for its choices.
    """
    tokens = _complete(expression)
    words = _operands(tokens)
    labels = {t for t in words if t not in _STRENGTH and t not in "()"}
    found = _choices(tokens, MOST_LISTED)
    return labels, [" ".join(words)] if found is None else [" and ".join(sorted(c)) for c in found]


def _automaton(phrases):
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in phrases:
        found.add_word(phrase, phrase)
    found.make_automaton()
    return found


def scan(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Places and labels of licences in each text.

    Returns one row per input row: the id, ``n_words``, ``places`` (word
    numbers of the base phrases, ascending), ``base_labels``, ``labels`` (with
    those of further phrases and identifier tags), ``choices`` (alternatives
    offered by tags, each its licences joined by `` and ``; an expression with too
    many to list stands there itself) and ``score``
    (how sure a licence is named, 0 to 1: by the
    places of all phrases and the alternatives of tags). Null and empty texts name none.
    Repeated and null ids stay as they are; other columns are not carried.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _automaton([f" {p} " for p in {**MORE_PHRASES, **BASE_PHRASES}])
        tags = _automaton(TAGS)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for value in batch.column(1):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                for column, item in zip(out, _one(raw, phrases, tags)):
                    column.append(item)
            strings = pa.list_(pa.string())
            kinds = (pa.int64(), pa.list_(pa.int64()), strings, strings, strings, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], names)

    names = ["id", "n_words", "places", "base_labels", "labels", "choices", "score"]
    schema = "id long, n_words long, places array<long>, base_labels array<string>, labels array<string>, choices array<string>, score double"
    docs = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(each, schema).withColumnRenamed("id", id)


def _one(raw: bytes, phrases, tags):
    words = raw.translate(_WORDS).split()
    line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte
    places, base, more, further = [], set(), set(), 0
    for end, phrase in phrases.iter(line):
        phrase_words = phrase.strip()
        if phrase_words in BASE_PHRASES:
            places.append(line.count(" ", 0, end - len(phrase) + 2) - 1)
            base.add(BASE_PHRASES[phrase_words])
        else:
            more.add(MORE_PHRASES[phrase_words])
            further += 1
    offered: list[str] = []
    seen = raw.translate(_LOWER).decode("latin-1")
    if "license-identifier:" in seen:
        for end in sorted({e for e, _ in tags.iter(seen)}):
            stop = seen.find("\n", end)
            names, ways = named(seen[end + 1 : stop if stop >= 0 else len(seen)])
            more |= names
            offered += ways
    score = 1 - (1 - PHRASE_WEIGHT) ** (len(places) + further) * (1 - TAG_WEIGHT) ** len(offered)
    return len(words), sorted(places), sorted(base), sorted(base | more), sorted(set(offered)), float(score)
