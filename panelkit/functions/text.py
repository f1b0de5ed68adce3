"""Text rules: words, numbers, masks and templates."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import as_column

# The templates of pair and prompt texts, and the shape of a
# word that parses as a float.
PAIR_TEMPLATES = {
    "persons": ("Person 0: ", "\nPerson 1: "),
    "separator": ("", " \n [SEP] "),
}
PROMPT_TAIL = ("\nlife span: ", "\n\n")
PROMPT_TAIL_WORDS = 3
FLOAT_PATTERN = (
    r"^[+-]?(inf|infinity|nan|([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)"
    r"(e[+-]?[0-9](_?[0-9])*)?)$"
)


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a regex class."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(
        f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs
    )


@lru_cache(maxsize=None)
def _class_codes(name: str) -> list[int]:
    """All code points of a Python string test: 'isspace' or 'isdigit'."""
    test = getattr(str, name)
    return [c for c in range(0x110000) if test(chr(c))]


def flat_class(name: str) -> str:
    """The class as one list of ranges, for any regex dialect."""
    return f"[{_ranges(_class_codes(name))}]"


@lru_cache(maxsize=None)
def _fast_class(name: str) -> str:
    """The class for Java: an ASCII character is settled by its first tests."""
    codes = _class_codes(name)
    ascii_part = _ranges([c for c in codes if c < 0x80])
    rest = _ranges([c for c in codes if c >= 0x80])
    return f"[{ascii_part}[\\x{{80}}-\\x{{10FFFF}}&&[{rest}]]]"


def space_class() -> str:
    return _fast_class("isspace")


def digit_class() -> str:
    return _fast_class("isdigit")


def words(text: Column | str) -> Column:
    """Whitespace-separated words, no empty ones."""
    return F.filter(F.split(as_column(text), space_class() + "+"), lambda w: w != "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text))


def is_blank(text: Column | str) -> Column:
    """Empty or nothing but whitespace."""
    return as_column(text).rlike(f"^{space_class()}*$")


def mask_numbers(text: Column | str) -> Column:
    """Each run of digits becomes one '*'; a run right after a '*' vanishes."""
    return F.regexp_replace(as_column(text), r"\*?" + digit_class() + "+", "*")


def number_after(text: Column | str, word: Column | str) -> Column:
    """The number right after the first occurrence of ``word``, of any length, else null."""
    w = words(text)
    target = F.lit(word) if isinstance(word, str) else word
    pos = F.array_position(w, target)
    following = F.when(pos > 0, F.try_element_at(w, (pos + 1).cast("int")))
    return F.when(following.rlike("^[0-9]+$"), following.cast("double"))


def first_match(items: Column, test) -> Column:
    """First element of the array that satisfies ``test``, else null."""
    return F.try_element_at(F.filter(items, test), F.lit(1))


def field_number(headers: Column, contents: Column, header: str, word: str) -> Column:
    """Number after ``word`` in the first field named ``header`` that has one."""
    pairs = F.zip_with(
        headers, contents, lambda h, c: F.struct(h.alias("h"), number_after(c, word).alias("n"))
    )
    return first_match(pairs, lambda p: (p["h"] == header) & p["n"].isNotNull())["n"]


def pair_text(first: Column | str, second: Column | str, template: str = "persons") -> Column:
    head, middle = PAIR_TEMPLATES[template]
    return F.concat(F.lit(head), as_column(first), F.lit(middle), as_column(second))


def prompt_text(text: Column | str, label: Column | str) -> Column:
    head, tail = PROMPT_TAIL
    number = as_column(label).cast("bigint").cast("string")
    return F.concat(as_column(text), F.lit(head), number, F.lit(tail))


def author_name(parts: Column) -> Column:
    return F.array_join(parts, " ")


def is_float(token: Column | str) -> Column:
    return F.lower(as_column(token)).rlike(FLOAT_PATTERN)


def to_number(token: Column | str) -> Column:
    """The value of a text that ``is_float``, else null; '_' between digits is skipped."""
    plain = F.replace(as_column(token), F.lit("_"), F.lit(""))
    return F.when(is_float(token), plain.try_cast("double"))


def float_text(value: Column) -> Column:
    """A double as 'nan', '3.0', '15000000.0' or '1.5e-05': fixed point from 1e-4 up to 1e16."""
    v = value.cast("double")
    size = F.abs(v)
    shown = v.cast("string")
    fixed = F.regexp_replace(shown.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    fixed = F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed)
    parts = F.split(shown, "E")
    power = F.try_element_at(parts, F.lit(2)).cast("int")
    sign = F.when(power < 0, "e-").otherwise("e+")
    digits = F.abs(power).cast("string")
    digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    short = F.concat(F.regexp_replace(parts[0], r"\.0$", ""), sign, digits)
    return (
        F.when(v.isNull() | F.isnan(v), "nan")
        .when(size == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
        .when((v == 0) | size.between(1e-3, 1e6), shown)
        .when((size >= 1e-4) & (size < 1e16), fixed)
        .otherwise(short)
    )


def int_text(value: Column) -> Column:
    """Digits of the value cut to an integer."""
    return value.cast("bigint").cast("string")


def cell_text(name: Column, value: Column, style: str) -> Column:
    """One feature of a rendered row; null where the style skips the cell.

    plain  'name 3 '      skips nulls
    comma  'name 3 , '    skips nulls
    raw    'name 3.0 , '  nulls as 'nan'
    token  'name_3 '      nulls as '#'
    """
    if style == "plain":
        return F.concat(name, F.lit(" "), int_text(value), F.lit(" "))
    if style == "comma":
        return F.concat(name, F.lit(" "), int_text(value), F.lit(" , "))
    if style == "raw":
        return F.concat(name, F.lit(" "), float_text(value), F.lit(" , "))
    if style == "token":
        return F.concat(name, F.lit("_"), F.coalesce(int_text(value), F.lit("#")), F.lit(" "))
    raise ValueError(f"unknown style {style!r}")
