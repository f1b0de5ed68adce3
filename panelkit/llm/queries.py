"""The operators bound to the tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    decontamination,
    license_scan,
    minhash_forest,
    periodic_runs,
    ptolemaic_clusters,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity_crf,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c.cast("binary"), F.lit(b"")), 256)


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


@query
def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), digest(F.col("kept")).alias("kept_sha256"))


@query
def op5_minhash_forest(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf, "documents"), width=2)


@query
def op8_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(joined).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op10_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf, "documents"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), joined("base_labels"), joined("labels"), "score",
    )


@query
def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long")
    base = F.filter("secrets", lambda x: x["k"] < 3)
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        digest(secret_scan.listed(base)).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"),
    )


@query
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SHARDS = [f"shard-{i:02d}" for i in range(16)]


@query
def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.place(table(spark, sf, "documents").select("doc_id"), ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


_names = "[" + ", ".join(f"'{s}'" for s in SHARDS) + "]"
_number = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_slots, _shards = sharding.SLOTS, len(SHARDS)
SQL["op4_sharding"] = f"""
WITH RECURSIVE walk AS (
  SELECT list_transform({_names}, lambda s: {_number.format("s || ':offset'")} % {_slots}) AS start,
         list_transform({_names}, lambda s: {_number.format("s || ':skip'")} % ({_slots} - 1) + 1) AS skip
), fill AS (
  SELECT 0 AS turn, list_transform(range({_slots}), lambda x: -1) AS taken
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(taken[1:slot], [(turn % {_shards})::INTEGER]), taken[slot + 2:])
  FROM (
    SELECT turn, taken, list_filter(list_transform(range({_slots}), lambda j: (start[turn % {_shards} + 1] + j * skip[turn % {_shards} + 1]) % {_slots}),
                                    lambda x: taken[x + 1] = -1)[1] AS slot
    FROM fill, walk WHERE turn < {_slots}
  )
), filled AS (
  SELECT unnest(range({_slots})) AS slot, unnest(taken) AS owner FROM fill WHERE turn = {_slots}
)
SELECT doc_id, slot::INTEGER AS slot, ({_names})[owner + 1] AS shard
FROM (SELECT doc_id, {_number.format("doc_id::VARCHAR")} % {_slots} AS slot FROM documents) JOIN filled USING (slot)
"""


@query
def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_ptolemaic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    out = ptolemaic_clusters.cluster(table(spark, sf, "embeddings"))
    components = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest(components).alias("centroid_sha256"))


def _clusters_sql(clusters: int, rounds: int, width: int) -> str:
    gap = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT row, best.k AS cluster, best.d AS distance
  FROM (SELECT row, min({{'d': {gap}, 'k': k}}) AS best FROM vectors, c{r} GROUP BY row)
)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m
    FROM (SELECT cluster, i, sum(v)::HUGEINT AS s, count(*) AS n
          FROM (SELECT cluster, unnest(x) AS v, unnest(range({width})) AS i FROM a{r} JOIN vectors USING (row)) GROUP BY cluster, i)
    GROUP BY cluster
  ) ON cluster = k
)""")
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({ptolemaic_clusters.SCALE} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {width}
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
  FROM (SELECT sha256('1:' || vec_id) AS h, x FROM vectors ORDER BY h, x LIMIT {clusters})
),{",".join(steps)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (row) JOIN c{rounds} ON k = cluster
"""


SQL["op11_ptolemaic_clusters"] = _clusters_sql(ptolemaic_clusters.CLUSTERS, ptolemaic_clusters.ROUNDS, ptolemaic_clusters.WIDTH)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """One document of ten, by the checksum of its id, repeats a stretch of its words to its end."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = docs.select("doc_id", "text", (crc % 10).alias("h"), F.floor(crc / 10).alias("g"))
    out = out.withColumn("words", F.when(F.col("h") == 0, words)).withColumn("n", F.size("words").cast("long"))
    out = out.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    out = out.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform("words", lambda w, i: F.get("words", at(i.cast("long")).cast("int")))
    return out.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = periodic_runs.runs(with_planted_runs(table(spark, sf, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", best).withColumn("lines", F.array_join(lines, ""))
    length, period = F.col("best.l"), -F.col("best.p")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), digest(F.col("lines")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


@query
def op13_toxicity_crf(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity_crf.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
