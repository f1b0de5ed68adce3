"""The panel in long form, one row per (id, feature), and its feature groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from ..functions import codes, names
from ..functions.text import to_number
from ..sources.staging import stage
from .joins import lookup_join
from .ordering import number_ordered
from .quantiles import quantile_at, rank_steps

# Fixed values of the chunk rule: run length and the shortest tail kept.
CHUNK_SIZE = 60
MIN_TAIL = 31
# Fixed values of the split gates.
MAX_NULL_PERCENT = 99
MIN_SIDE = 40
MAX_MISSING_COLUMNS = 10


def wave_order(features: Sequence[str]) -> list[str]:
    """A table's column names sorted by wave, the given order kept inside."""

    def wave(name: str) -> str:
        return next((c for c in name if c in "0123456789"), names.NO_WAVE)

    return sorted(features, key=wave)


def melt(df: DataFrame, key: str, features: Sequence[str] | None = None) -> DataFrame:
    """Wide table -> (key, feature, value, text); a cell fills one of the two."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in (features or df.columns) if c != key]
    pairs = []
    for c in cols:
        numeric = isinstance(types[c], NumericType)
        v = F.col(c).cast("double") if numeric else F.lit(None).cast("double")
        t = F.lit(None).cast("string") if numeric else F.col(c).cast("string")
        pairs.append(F.struct(F.lit(c).alias("feature"), v.alias("value"), t.alias("text")))
    return df.select(key, F.inline(F.array(*pairs)))


def feature_catalog(cells: DataFrame) -> DataFrame:
    """The features of a long panel: feature, wave, stem, class."""
    return cells.select("feature").distinct().transform(describe_features)


def describe_features(features: DataFrame) -> DataFrame:
    return features.select(
        "feature",
        names.wave_of("feature").alias("wave"),
        names.stem_of("feature").alias("stem"),
        names.class_prefix("feature").alias("class"),
    )


def order_by_wave(features: DataFrame, position: str) -> DataFrame:
    """Features with their 1-based place ``ord`` in (wave, position) order."""
    waved = features.withColumn("wave", names.wave_of("feature"))
    return number_ordered(waved, ["wave", position], out="ord")


def column_profile(cells: DataFrame, text: str | None = None) -> DataFrame:
    """Per feature: valid cells, distinct valid values, population deviation.

    With one valid cell or none ``n_unique`` is 0 and ``std`` null; ``std`` is
    null for features with text as well.
    """
    valid = codes.is_valid("value", text)
    shown = F.col("value").cast("string")
    key = F.coalesce(shown, F.col(text)) if text else F.col("value")
    numeric = F.col("value").isNotNull()
    per_feature = cells.groupBy("feature").agg(
        F.count_if(valid).alias("n_valid"),
        F.count_distinct(F.when(valid, key)).alias("_unique"),
        F.stddev_pop(F.when(valid, F.col("value"))).alias("_std"),
        F.count_if(valid & ~numeric).alias("_texts"),
    )
    several = F.col("n_valid") > 1
    return per_feature.select(
        "feature",
        names.wave_of("feature").alias("wave"),
        "n_valid",
        F.when(several, F.col("_unique")).otherwise(F.lit(0)).alias("n_unique"),
        F.when(several & (F.col("_texts") == 0), F.col("_std")).alias("std"),
    )


def columns_per_wave(features: DataFrame) -> DataFrame:
    return features.groupBy(names.wave_of("feature").alias("wave")).agg(
        F.count("*").alias("n_columns")
    )


def usable_features(profile: DataFrame) -> DataFrame:
    """Features with values, in one of the waves that form stem groups."""
    return profile.where((F.col("n_unique") > 0) & F.col("wave").isin(*names.STEM_WAVES))


def stem_groups(features: DataFrame) -> DataFrame:
    """stem -> its columns in wave order.

    A stem of length L has at most (L + 1) * 5 columns, so the lists are short.
    """
    cat = features.where(names.wave_of("feature").isin(*names.STEM_WAVES)).select(
        "feature", names.wave_of("feature").alias("wave"), names.stem_of("feature").alias("stem")
    )
    ordered = F.array_sort(F.collect_list(F.struct("wave", "feature")))
    return cat.groupBy("stem").agg(
        F.transform(ordered, lambda x: x["feature"]).alias("columns"),
        F.array_sort(F.collect_set("wave")).alias("waves"),
        F.count("*").alias("n_columns"),
    )


def stem_wave_sets(groups: DataFrame) -> DataFrame:
    """Stems with two columns or more, each with its wave set."""
    return groups.where("n_columns > 1").select(
        names.wave_set_code(F.col("waves")).alias("comb"), "stem", "waves", "columns"
    )


def wave_set_groups(groups: DataFrame) -> DataFrame:
    """Per wave set: how many stems have exactly these waves."""
    return stem_wave_sets(groups).groupBy("comb").agg(F.count("*").alias("n_stems"))


def good_bad_sets(groups: DataFrame) -> DataFrame:
    """Stems with more than one column, and with just one."""
    return groups.agg(
        F.count_if(F.col("n_columns") > 1).alias("good_sets"),
        F.count_if(F.col("n_columns") <= 1).alias("bad_sets"),
    )


def column_kinds(cells: DataFrame, split: DataFrame) -> DataFrame:
    """How many columns hold text, how many numeric ones pass both gates of the median split, and how many there are."""
    kinds = cells.groupBy("feature").agg(F.max(F.col("text").isNotNull()).alias("is_text"))
    passed = split.select("feature", (F.col("dense") & F.col("balanced")).alias("passed"))
    usable = ~F.col("is_text") & F.coalesce("passed", F.lit(False))
    # A row for each column of the panel.
    return kinds.join(passed, "feature", "left").agg(
        F.count_if("is_text").alias("text_columns"), F.count_if(usable).alias("usable_columns"), F.count("*").alias("n_columns")
    )


def feature_chunks(
    features: DataFrame, size: int = CHUNK_SIZE, min_tail: int = MIN_TAIL
) -> DataFrame:
    """Runs of ``size`` stems per wave set, one chunk per run and wave.

    Sets are ordered by code, stems by name. A run is kept when at least
    ``min_tail`` stems are left at its start. ``chunk_index`` counts all
    chunks, ``chunk_index_without_year`` the wave sets, ``piece`` the runs.
    """
    stems = stage(stem_wave_sets(stem_groups(features)), "stems")
    # One row per set of waves: at most 2**5 - 1 of them.
    sets = stems.groupBy("comb").agg(F.count("*").alias("_n"), F.first("waves").alias("_waves"))
    by_set = Window.orderBy("comb")
    runs = F.greatest(F.lit(0), F.ceil((F.col("_n") - (min_tail - 1)) / F.lit(size)))
    sets = sets.select(
        "comb", "_n", "_waves",
        runs.alias("_runs"),
        (F.row_number().over(by_set) - 1).alias("chunk_index_without_year"),
        F.coalesce(
            F.sum(runs * F.size("_waves")).over(
                by_set.rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_before"),
    )
    placed = number_ordered(
        stems.select("comb", "stem", "columns"), ["stem"], within=["comb"], out="_place"
    ).withColumn("_place", F.col("_place") - 1)
    kept = (
        placed.join(F.broadcast(sets), "comb")
        .withColumn("piece", F.floor(F.col("_place") / size))
        .where(F.col("piece") * size < F.col("_n") - (min_tail - 1))
    )
    cells = kept.select("*", F.explode("columns").alias("_column")).withColumn(
        "year", names.wave_of("_column")
    )
    wave_no = F.array_position("_waves", F.col("year")) - 1
    # A chunk has at most ``size`` stems: its list is short.
    listed = F.array_sort(F.collect_list(F.struct("_place", "_column")))
    return cells.groupBy(
        "year",
        "comb",
        (F.col("_before") + wave_no * F.col("_runs") + F.col("piece")).cast("bigint").alias("chunk_index"),
        F.col("chunk_index_without_year").cast("bigint"),
        F.col("piece").cast("bigint"),
    ).agg(F.transform(listed, lambda x: x["_column"]).alias("chunk"))


def wave_columns(features: DataFrame, stems: DataFrame, wave: str | None = None) -> DataFrame:
    """For each listed stem its column of the given wave, or of every wave."""
    cat = describe_features(features)
    cat = (cat if wave is None else cat.where(F.col("wave") == wave)).select("stem", "feature")
    return lookup_join(cat, stems.select("stem").distinct(), ["stem"])


def select_available(
    chunks: DataFrame, features: DataFrame, max_missing: int | None = MAX_MISSING_COLUMNS
) -> DataFrame:
    """Keep a chunk's columns that exist; drop chunks that miss too many."""
    listed = chunks.select("chunk_index", F.posexplode("chunk").alias("_pos", "feature"))
    have = features.select("feature").distinct().withColumn("_have", F.lit(True))
    found = lookup_join(listed, stage(have, "have"), ["feature"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("_have"), F.struct("_pos", "feature"))))
    out = found.groupBy("chunk_index").agg(
        F.transform(kept, lambda x: x["feature"]).alias("chunk"),
        F.count_if(F.col("_have").isNull()).alias("n_missing"),
    )
    return out if max_missing is None else out.where(F.col("n_missing") <= max_missing)


def numeric_features(cells: DataFrame, text: str = "text") -> DataFrame:
    """Features of a text-typed panel whose every filled cell is a number."""
    filled = F.col(text).isNotNull()
    return (
        cells.groupBy("feature")
        .agg(F.count_if(filled & to_number(text).isNull()).alias("_bad"))
        .where("_bad = 0")
        .select("feature")
    )


def drop_text_columns(cells: DataFrame, text: str = "text") -> DataFrame:
    """Cells of numeric features only, the text read as a number."""
    keep = stage(numeric_features(cells, text), "numeric")
    return lookup_join(cells, keep, ["feature"], "left_semi").withColumn(
        "value", to_number(text)
    )


def median_split(
    cells: DataFrame,
    n_rows: int | None = None,
    max_null_percent: float = MAX_NULL_PERCENT,
    min_side: int = MIN_SIDE,
) -> DataFrame:
    """Per feature the exact median, both sides, and whether the gates pass.

    ``n_rows`` is the number of panel rows; absent cells then count as null.
    Without it the rows of the feature in ``cells`` are counted.
    """
    clean = cells.select("feature", codes.sentinel_to_null("value").alias("value"))
    steps = rank_steps(clean, ["feature"], "value", [0.5])
    steps = stage(steps, "median_steps")
    medians = steps.groupBy("feature").agg(
        F.max("n_total").alias("n_valid"), quantile_at(0.5).alias("median")
    )
    point, m = F.col("point"), F.col("median")
    sides = (
        lookup_join(steps, stage(medians, "medians"), ["feature"])
        .groupBy("feature", "n_valid", "median")
        .agg(
            F.sum(F.when(point.isNull() | (point < m), F.col("n")).otherwise(0)).alias("below"),
            F.sum(F.when(~F.col("gap") & (point == m), F.col("n")).otherwise(0)).alias("equal"),
        )
        .withColumn("above", F.col("n_valid") - F.col("below") - F.col("equal"))
    )
    if n_rows is None:
        totals = cells.groupBy("feature").agg(F.count("*").alias("n_rows"))
        sides = sides.join(totals, "feature")
    else:
        sides = sides.withColumn("n_rows", F.lit(n_rows).cast("bigint"))
    smaller = F.col("below") < F.col("above")
    low = F.col("below") + F.when(smaller, F.col("equal")).otherwise(F.lit(0))
    high = F.col("n_valid") - low
    nulls = (F.col("n_rows") - F.col("n_valid")) / F.col("n_rows") * 100
    return sides.select(
        "feature", "n_rows", "n_valid", "median", "below", "equal", "above",
        smaller.alias("below_smaller"),
        low.alias("zeros"),
        high.alias("ones"),
        (nulls <= max_null_percent).alias("dense"),
        ((low >= min_side) & (high >= min_side)).alias("balanced"),
    )


def drop_sparse_features(split: DataFrame) -> DataFrame:
    return split.where("dense")


def drop_unbalanced_features(split: DataFrame) -> DataFrame:
    return split.where("balanced")


def binarize_cells(cells: DataFrame, split: DataFrame) -> DataFrame:
    """Cells of the features that pass both gates, as 0/1 (null stays null)."""
    kept = drop_unbalanced_features(drop_sparse_features(split)).select(
        "feature", "median", "below_smaller"
    )
    clean = cells.withColumn("value", codes.sentinel_to_null("value"))
    joined = lookup_join(clean, stage(kept, "split"), ["feature"])
    bit = codes.binarize(F.col("value"), F.col("median"), F.col("below_smaller"))
    return joined.withColumn("value", bit).drop("median", "below_smaller")
