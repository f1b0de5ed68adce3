"""Array rules: vectors, logits and printed lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import as_column
from .text import words


def parse_list_literal(text: Column | str) -> Column:
    """A printed list of names -> array; quotes may be single or double."""
    return F.from_json(as_column(text), "array<string>", {"allowSingleQuotes": "true"})


def parse_vector(text: Column | str) -> Column:
    """'[0.1 0.2 ...]' -> array of doubles."""
    inner = F.regexp_replace(as_column(text), r"^\[|\]$", "")
    return F.transform(words(inner), lambda w: w.cast("double"))


def print_vector(values: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(as_column(values).cast("array<string>"), " "), F.lit("]"))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def argmax(values: Column) -> Column:
    """0-based index of the largest element, first on ties."""
    return F.array_position(values, F.array_max(values)) - 1


def vector_mean(vectors: Column, dim: int) -> Column:
    """Element-wise mean of a short array of vectors."""
    total = F.aggregate(
        vectors,
        F.array_repeat(F.lit(0.0), dim),
        lambda s, v: F.zip_with(s, v.cast("array<double>"), lambda x, y: x + y),
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def dispersion(vectors: Column, dim: int) -> Column:
    """Mean distance to the centroid of a short array of vectors."""
    return F.aggregate(
        F.array(F.struct(vectors.alias("vs"), vector_mean(vectors, dim).alias("c"))),
        F.lit(0.0),
        lambda _, g: F.aggregate(
            F.transform(g["vs"], lambda v: l2_distance(v.cast("array<double>"), g["c"])),
            F.lit(0.0),
            lambda s, d: s + d,
        ),
    ) / F.size(vectors)
