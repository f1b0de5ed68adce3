"""Word-level vocabulary and fixed-length encodings of rendered rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import digests, draws
from ..functions import text as tx
from ..sources.staging import stage

# Vocabulary size, special tokens in id order, row length,
# masking share, and what becomes of a masked token.
VOCAB_SIZE = 300
SPECIAL_TOKENS = ("[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]")
UNK, PAD, CLS, SEP, MASK = range(5)
MAX_LENGTH = 80
MASK_SHARE = 0.15
MASK_TO_MASK = 0.8
MASK_TO_RANDOM = 0.1
IGNORED_TARGET = -100


def tokens(text: Column | str) -> Column:
    """Pieces between single spaces, no empty ones."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, " "), lambda t: t != "")


#: Bytes of text whose words are counted at once.
COUNTED_BYTES = 1 << 24


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``tokens`` of a batch, and the row of each."""
    pieces = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words = pieces.flatten()
    real = pc.not_equal(words, "")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """How often each token occurs; a batch is counted with arrays, so that Spark adds counts and not tokens."""

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        found = pc.value_counts(_words(pa.concat_arrays(held))[0])
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            held.append(batch.column(0))
            if sum(a.nbytes for a in held) >= COUNTED_BYTES:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    part = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token string, n bigint")
    return part.groupBy("token").agg(F.sum("n").alias("n"))


def top_vocab(
    counts: DataFrame, size: int = VOCAB_SIZE, special: Sequence[str] = SPECIAL_TOKENS
) -> DataFrame:
    """Special tokens first, then the most frequent ones, ties by token."""
    room = size - len(special)
    ranked = counts.orderBy(F.desc("n"), "token").limit(room)
    # ``size`` rows at most, so one task numbers them.
    order = Window.orderBy(F.desc("n"), "token")
    words = ranked.select(
        "token", (F.row_number().over(order) + len(special) - 1).alias("id"), "n"
    )
    fixed = counts.sparkSession.createDataFrame(
        [(t, i) for i, t in enumerate(special)], "token string, id int"
    ).withColumn("n", F.lit(None).cast("bigint"))
    return fixed.unionByName(words)


#: Words that one row can list.
MOST_WORDS = 1_000_000


def word_table(vocab: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The words and their ids, of equal words the lowest id first.

    Their number is measured; a word is then looked up inside the row.
    """
    n = vocab.count()
    if n > MOST_WORDS:
        raise ValueError(f"{n} words are too many for a table that every task holds")
    own = sorted((r.id, r.token) for r in vocab.select("id", "token").where("token IS NOT NULL").toLocalIterator())
    return pa.array([t for _, t in own], pa.string()), np.array([i for i, _ in own], dtype=np.int32)


def encode(
    texts: DataFrame, key: Sequence[str], vocab: DataFrame, max_length: int = MAX_LENGTH,
    text: str = "text",
) -> DataFrame:
    """Texts -> input_ids, attention_mask and special_tokens_mask of one length.

    A text is cut to leave room for [CLS] and [SEP], unknown tokens become
    [UNK], short rows are filled with [PAD].
    """
    body = max_length - 2
    known, numbers = word_table(vocab)

    def number(texts: pa.Array) -> pa.Array:
        words, row = _words(texts)
        n = np.bincount(row, minlength=len(texts))
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)
        ids = np.append(numbers, np.int32(UNK))[at]
        out = np.full((len(texts), max_length), PAD, dtype=np.int32)
        kept = place < body
        out[row[kept], place[kept] + 1] = ids[kept]
        out[:, 0] = CLS
        out[np.arange(len(texts)), np.minimum(n, body) + 1] = SEP
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * max_length, pa.int32()), pa.array(out.ravel()))

    ids = F.col("input_ids")
    rows = texts.select(*key, F.arrow_udf(number, "array<int>")(F.col(text)).alias("input_ids"))
    return rows.select(
        *key,
        ids,
        attention_mask(ids).alias("attention_mask"),
        special_tokens_mask(ids).alias("special_tokens_mask"),
    )


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def special_tokens_mask(ids: Column) -> Column:
    """1 for [CLS], [SEP] and padding; an unknown word is a real token."""
    return F.transform(ids, lambda x: x.isin(PAD, CLS, SEP).cast("int"))


def mlm_mask(
    encoded: DataFrame, key: Sequence[str], vocab_size: int = VOCAB_SIZE,
    share: float = MASK_SHARE, seed: object = 0,
) -> DataFrame:
    """Choose prediction targets; hide 80 %, replace 10 %, keep 10 % of them.

    ``labels`` holds the original id of a target and -100 elsewhere.
    """
    own = encoded.schema["input_ids"].dataType.elementType
    kind = "bigint" if own.simpleString() == "bigint" else "int"

    # Both results follow from one draw for each place; padding and other marks have none.
    def pick_targets(texts: pa.Array, lists: pa.Array) -> pa.Array:
        width = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        empty = values.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(values, PAD).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero((ids != PAD) & (ids != CLS) & (ids != SEP))
        row = np.repeat(np.arange(len(lists)), width)[at]
        place = at - (np.cumsum(width) - width)[row]

        def drawn(use: str, some: np.ndarray) -> np.ndarray:
            return digests.draws_of(digests.joined([pa.scalar(str(seed)), pa.scalar(use), texts]), row[some], place[some])

        every = np.arange(len(at))
        some = every if share >= 1 else np.flatnonzero(digests.below(drawn("pick", every), share))
        fate, other = drawn("fate", some), drawn("token", some) % vocab_size
        old = ids[at[some]]
        swapped = np.where(digests.below(fate, MASK_TO_MASK), MASK, np.where(digests.below(fate, MASK_TO_MASK + MASK_TO_RANDOM), other, old))
        labels = np.full(len(ids), IGNORED_TARGET, dtype=np.int64)
        labels[at[some]] = old
        ids[at[some]] = swapped
        arrow = pa.int64() if kind == "bigint" else pa.int32()
        ends = np.concatenate([[0], np.cumsum(width)])
        absent = lists.is_null()
        both = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), a, mask=absent if absent.true_count else None) for a in (pa.array(ids, mask=empty).cast(arrow), pa.array(labels).cast(arrow))]
        return pa.StructArray.from_arrays(both, ["input_ids", "labels"])

    masked = F.arrow_udf(pick_targets, f"input_ids array<{kind}>, labels array<{kind}>")
    rows = encoded.select(*key, F.col("input_ids").cast(f"array<{kind}>").alias("input_ids"), _filled("input_ids").alias("_n"))
    # The padding at the end stays here.
    rows = rows.select(
        *key,
        F.slice("input_ids", F.col("_n") + 1, F.size("input_ids") - F.col("_n")).alias("_rest"),
        masked(draws.key_text(*key), F.slice("input_ids", F.lit(1), F.col("_n"))).alias("_masked"),
    )
    ignored = F.array_repeat(F.lit(IGNORED_TARGET).cast(kind), F.size("_rest"))
    return rows.select(*key, F.concat("_masked.input_ids", "_rest").alias("input_ids"), F.concat("_masked.labels", ignored).alias("labels"))


def _filled(ids: str) -> Column:
    """How many ids stand before the padding at the end; all of them if padding also stands between ids."""
    first = F.array_position(ids, F.lit(PAD)).cast("int")
    tail = (first > 0) & (F.size(F.array_remove(ids, F.lit(PAD))) == first - 1)
    return F.when(tail, first - 1).otherwise(F.size(ids))


def truncation_audit(
    texts: DataFrame, key: Sequence[str], max_words: int, text: str = "text", group: int = 3
) -> DataFrame:
    """What a cut after ``max_words`` words loses of each text.

    ``last_name`` is the last kept word that is neither a number nor a comma;
    a text of ``group`` words per feature is complete when that name belongs
    to its last feature.
    """
    w = tx.words(text)
    kept = F.slice(F.col("_w"), 1, max_words)
    names = F.filter(kept, lambda t: ~tx.is_float(t) & (t != ","))
    n, k = F.size("_w"), F.size(kept)
    # F.get is 0-based and null beyond the ends.
    last_name = F.get(names, F.size(names) - 1)
    place = (F.array_position("_w", last_name) - 1) / F.lit(group)
    return texts.select(*key, w.alias("_w")).select(
        *key,
        n.alias("n_words"),
        k.alias("n_kept"),
        F.when(n > 0, (n - k) / n).otherwise(F.lit(0.0)).alias("lost_share"),
        last_name.alias("last_name"),
        (place >= n / F.lit(group) - 1).alias("complete"),
    )


def decoded_in_source(
    encoded: DataFrame, texts: DataFrame, key: Sequence[str], vocab: DataFrame, text: str = "text"
) -> DataFrame:
    """Rows with a decoded token that their source text does not contain.

    Special tokens aside, every id must decode to a token of the text, so the
    result is empty when encoding loses nothing but the cut tail.
    """
    if vocab.count() > MOST_WORDS:
        raise ValueError("the vocabulary is too large for a table that every task holds")
    # ``size`` entries at most.
    known = vocab.agg(F.map_from_entries(F.collect_list(F.struct("id", "token"))).alias("words"))
    words = stage(known, "words").select("words").scalar()
    plain = F.filter(F.array_distinct("input_ids"), lambda x: ~x.isin(UNK, PAD, CLS, SEP, MASK))
    known = encoded.withColumn("_words", words)
    decoded = known.select(*key, F.transform(plain, lambda x: F.try_element_at(F.col("_words"), x)).alias("_decoded"))
    both = decoded.join(texts.select(*key, tokens(text).alias("_source")), list(key), "left")
    lost = F.array_except("_decoded", F.coalesce("_source", F.array().cast("array<string>")))
    return both.select(*key, F.explode(lost).alias("token"))
