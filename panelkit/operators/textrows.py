"""Rendered rows, labelled texts, pairs, prompts and author counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.draws import as_column
from ..sources.staging import stage
from .joins import fan_out, lookup_join
from .ordering import number_shuffled, renumber

# The fewest rows of a chunk, the words of a prompt.
MIN_CHUNK_ROWS = 100
PROMPT_WORDS = 3000


def render_rows(
    cells: DataFrame, key: str, features: Sequence[str], style: str = "plain"
) -> DataFrame:
    """One text per id, its features in the given order.

    The list of features is a table's column list. Only places in the list
    and values are shuffled; styles that show nulls ('raw', 'token') add the
    places an id has no value for, and keep ids without any value. See ``cell_text`` for the styles.
    """
    names = F.array(*[F.lit(f) for f in features])
    places = cells.sparkSession.range(len(features)).select(
        F.col("id").cast("int").alias("_place"), F.get(names, F.col("id").cast("int")).alias("feature")
    )
    with_nulls = style in ("raw", "token")
    rows = cells.select(key, "feature", "value")
    if not with_nulls:
        rows = rows.where(F.col("value").isNotNull())
    placed = lookup_join(rows, places, ["feature"], "left" if with_nulls else "inner").select(key, "_place", "value")
    listed = F.col("_place").isNotNull() & F.col("value").isNotNull()
    cell = F.when(listed, F.struct("_place", "value"))
    # One cell per (id, feature): the list is as long as the panel is wide.
    ids = placed.groupBy(key).agg(F.collect_list(cell).alias("_cells"))
    shown = F.col("_cells")
    if with_nulls:
        every = F.sequence(F.lit(0), F.lit(len(features) - 1))
        absent = F.array_except(every, F.transform("_cells", lambda c: c["_place"]))
        nothing = F.lit(None).cast("double").alias("value")
        shown = F.concat(shown, F.transform(absent, lambda p: F.struct(p.alias("_place"), nothing)))
    parts = F.transform(
        F.array_sort(shown), lambda c: tx.cell_text(F.get(names, c["_place"]), c["value"], style)
    )
    return ids.select(key, F.array_join(parts, "").alias("text"))


def render_samples(samples: DataFrame, key: str, style: str = "plain", shown: str | None = None) -> DataFrame:
    """Texts of sampled cells: (key, sample_no, text).

    ``shown`` names a field of the cells with their text in this style, made before a cell was taken into many samples.
    """
    parts = F.col("cells")[shown] if shown else F.transform("cells", lambda c: tx.cell_text(c["feature"], c["value"], style))
    return samples.select(key, "sample_no", F.array_join(parts, "").alias("text"))


def render_chunks(
    cells: DataFrame, key: str, chunks: DataFrame, style: str = "comma",
    min_rows: int | None = MIN_CHUNK_ROWS,
) -> DataFrame:
    """One text per (chunk, id) over the chunk's filled cells, all chunks in one job.

    Ids without any filled cell of the chunk give no text; chunks with fewer
    than ``min_rows`` texts are dropped.
    """
    listed = chunks.select("chunk_index", F.posexplode("chunk").alias("_pos", "feature"))
    filled = cells.where(F.col("value").isNotNull()).select(key, "feature", "value")
    spread = fan_out(filled, listed, ["feature"], "places")
    shown = tx.cell_text(F.col("feature"), F.col("value"), style)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("p"), shown.alias("t"))))
    texts = spread.groupBy("chunk_index", key).agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("text")
    )
    return texts if min_rows is None else drop_small_chunks(texts, min_rows)


def drop_small_chunks(texts: DataFrame, min_rows: int = MIN_CHUNK_ROWS) -> DataFrame:
    """Drop empty texts, then chunks with fewer than ``min_rows`` of them."""
    # The texts are counted and returned, but rendered once.
    kept = stage(texts.where("text <> ''"), "chunk_texts")
    big = kept.groupBy("chunk_index").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_rows)
    return lookup_join(kept, stage(big.select("chunk_index"), "big_chunks"), ["chunk_index"], "left_semi")


def labelled_texts(records: DataFrame, header: str = "death_date", word: str = "aged") -> DataFrame:
    """Nested infobox records -> (text, masked_text, label).

    The label is the number after ``word`` in the first field of that name
    which has one; records without a label are dropped.
    """
    table = F.col("input_text")["table"]
    label = tx.field_number(table["column_header"], table["content"], header, word)
    keep = [c for c in records.columns if c not in ("input_text", "target_text")]
    return (
        records.withColumn("label", label.cast("double"))
        .where("label is not null")
        .select(
            *keep,
            F.col("target_text").alias("text"),
            tx.mask_numbers("target_text").alias("masked_text"),
            "label",
        )
    )


def match_rate(df: DataFrame, test: Column, by: Sequence[str] = ()) -> DataFrame:
    """How many records match, and their share."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_records"),
        F.count_if(test).alias("n_matches"),
        F.avg(F.coalesce(test, F.lit(False)).cast("double")).alias("match_share"),
    )


def pair_rows(
    df: DataFrame, key: str, text: str, label: str, seed: object, template: str = "persons"
) -> DataFrame:
    """Shuffle, pair neighbours, and put shorter and longer first in turn.

    An odd last row and pairs with equal labels are dropped. Label 0: the
    smaller value comes first; 1: the larger. ``diff`` is larger minus smaller.
    Only keys and labels take part in the numbering; texts join at the end.
    """
    rows = number_shuffled(df.select(key, label), [key], seed, out="_no")
    item = F.struct(F.col(label).alias("y"), F.col("_no").alias("no"), F.col(key).alias("k"))
    pairs = (
        rows.groupBy(F.floor((F.col("_no") - 1) / 2).alias("_pair"))
        .agg(F.count("*").alias("_n"), F.min(item).alias("_short"), F.max(item).alias("_long"))
        .where((F.col("_n") == 2) & (F.col("_short")["y"] != F.col("_long")["y"]))
    )
    pairs = stage(pairs.select("_pair", "_short", "_long"), "pairs")
    upper = pairs.agg(F.max("_pair")).first()[0] or 0
    numbered = renumber(pairs, "_pair", "pair_no", upper + 1).withColumn(
        "label", ((F.col("pair_no") - 1) % 2).cast("int")
    )
    short_first = F.col("label") == 0
    slots = numbered.select(
        "pair_no",
        "label",
        (F.col("_long")["y"] - F.col("_short")["y"]).alias("diff"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("slot"), F.when(short_first, F.col("_short")["k"]).otherwise(F.col("_long")["k"]).alias(key)),
                F.struct(F.lit(1).alias("slot"), F.when(short_first, F.col("_long")["k"]).otherwise(F.col("_short")["k"]).alias(key)),
            )
        ).alias("_s"),
    ).select("pair_no", "label", "diff", "_s.slot", F.col("_s")[key].alias(key))
    texts = slots.join(df.select(key, F.col(text).alias("_text")), key)

    def side(n: int) -> Column:
        return F.max(F.when(F.col("slot") == n, F.col("_text")))

    return texts.groupBy("pair_no", "label", "diff").agg(
        tx.pair_text(side(0), side(1), template).alias("pair_texts")
    )


def pack_prompt(
    df: DataFrame, order: str, text: str, label: str, budget: int = PROMPT_WORDS
) -> DataFrame:
    """The leading rows whose prompts stay within ``budget`` words.

    A row is taken while its own words plus all words so far fit; the first
    row that does not fit ends the prompt.
    """
    # Every row costs at least its tail words, so no row behind these can be in.
    most = budget // tx.PROMPT_TAIL_WORDS + 2
    lead = df.select(order, F.col(text).alias("_text"), F.col(label).alias("_label")).orderBy(order).limit(most)
    along = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = tx.n_words("_text").cast("bigint")
    cost = F.coalesce(words, F.lit(0)) + tx.PROMPT_TAIL_WORDS
    numbered = lead.select(
        order, tx.prompt_text("_text", "_label").alias("prompt"),
        F.count("*").over(along).alias("row_no"), words.alias("n_words"), F.sum(cost).over(along).alias("_upto"),
    )
    return numbered.where(F.col("_upto") - tx.PROMPT_TAIL_WORDS <= budget).drop("_upto")


def author_frequency(papers: DataFrame, authors: str = "authors_parsed", by: Sequence[str] = ()) -> DataFrame:
    """How often each author, its name parts joined, is listed."""
    # Names are joined inside the list: a row of an author then holds one text, not a list of parts.
    names = F.transform(as_column(authors), tx.author_name)
    named = papers.select(*by, F.explode(names).alias("author"))
    return named.groupBy(*by, "author").agg(F.count("*").alias("n_papers"))


def frequency_of_frequency(counts: DataFrame, count: str = "n_papers", by: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*by, count).agg(F.count("*").alias("n_authors"))
