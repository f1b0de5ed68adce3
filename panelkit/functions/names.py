"""Feature-name rules: the first digit of a name is its wave."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import as_column

# The wave of a name without digits, the waves that take part
# in stem groups, the prefixes of constructed features.
NO_WAVE = "999"
STEM_WAVES = ("1", "2", "3", "4", "5")
CONSTRUCTED_PREFIXES = ("cm", "cf")


def wave_of(name: Column | str) -> Column:
    """First digit of the name, else '999'."""
    found = F.regexp_extract(as_column(name), "([0-9])", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(NO_WAVE))


def stem_of(name: Column | str) -> Column:
    """The name without its first digit."""
    return F.regexp_replace(as_column(name), "^([^0-9]*)[0-9]", "$1")


def wave_set_code(waves: Column) -> Column:
    """Set of waves -> integer of its sorted digits, {3,1} -> 13."""
    return F.array_join(F.array_sort(waves), "").cast("int")


def is_constructed(name: Column | str) -> Column:
    c = as_column(name)
    out = F.lit(False)
    for prefix in CONSTRUCTED_PREFIXES:
        out = out | c.startswith(prefix)
    return out


def class_prefix(name: Column | str) -> Column:
    return F.when(is_constructed(name), F.lit("constructed")).otherwise(F.lit("raw"))
