"""The corpus pipeline: five stages, each a stored table that the next one reads."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, decontamination, minhash_forest, quality_classifier, secret_scan
from panelkit.llm.columns import free
from panelkit.llm.queries import table
from panelkit.llm.store import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts; labels come from the source, texts from the stage's input."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8).

    It is the row with the smallest id; a row without id stays only if its
    group has no id. Of rows with that id, the hash of the text decides. Each
    row gets a key of its own, stored once so that every later read sees the same.
    """
    key = free(docs, "row_key")
    docs = stage(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows")
    found = minhash_forest.near_duplicates(docs, id=key).select(key, "component_id")
    order = docs.select(key, F.struct(F.isnull("doc_id"), "doc_id", F.xxhash64("text"), key).alias("order"))
    found = stage(found.join(order, key), "near-groups")
    first = found.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col(f"first.{key}").alias(key))
    return docs.join(found.join(first, key, "left_anti").select(key), key, "left_anti").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets masked and ``n_chars`` of the new text."""
    spans = free(docs, "secrets")
    out = secret_scan.redact(secret_scan.scan(docs, spans=spans), spans=spans)
    return out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spans)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, ``n_tokens`` and the token ids of every document, with the text that they decode to."""
    ids, n = free(docs, "ids"), free(docs, "n_tokens")
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=ids)
    return out.withColumn(n, F.size(ids).cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("byte-level BPE", tokens),
]

#: Two stages cannot be written in SQL; the tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
