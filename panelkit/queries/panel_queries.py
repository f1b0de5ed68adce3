"""Panel profile, gates, chunks and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, codes
from ..operators import clean, panel as po, report
from ..operators.joins import lookup_join
from ..sources.staging import stage
from ..sources import files
from . import tables as t
from .registry import query, r6, table

CHUNK = dict(size=10, min_tail=4)


@query("column_profile", f"""WITH {t.PANEL_SQL}, s AS (
  SELECT feature, count(*) FILTER (value >= 0) AS n_valid,
         count(DISTINCT CASE WHEN value >= 0 THEN value END) AS u,
         stddev_pop(CASE WHEN value >= 0 THEN value END) AS sd
  FROM panel GROUP BY feature)
SELECT feature, regexp_extract(feature, '([0-9])', 1) AS wave, n_valid,
       CASE WHEN n_valid > 1 THEN u ELSE 0 END AS n_unique,
       CASE WHEN n_valid > 1 THEN round(sd, 4) END AS std FROM s""")
def column_profile(spark, sf):
    prof = po.column_profile(t.panel(spark, sf))
    return prof.select("feature", "wave", "n_valid", "n_unique", r6("std", "std", 4))


@query("columns_per_wave", f"""WITH {t.CATALOG_SQL}
SELECT coalesce(nullif(regexp_extract(feature, '([0-9])', 1), ''), '999') AS wave, count(*) AS n_columns
FROM catalog GROUP BY 1""")
def columns_per_wave(spark, sf):
    return po.columns_per_wave(t.catalog(spark, sf))


@query("feature_names", f"""WITH {t.CATALOG_SQL}, f AS (
  SELECT feature FROM catalog UNION ALL SELECT DISTINCT p_brand FROM part
  UNION ALL SELECT DISTINCT concat('cm', p_size, 'x') FROM part UNION ALL SELECT DISTINCT concat('cf', p_size) FROM part)
SELECT feature, coalesce(nullif(regexp_extract(feature, '([0-9])', 1), ''), '999') AS wave,
       regexp_replace(feature, '^([^0-9]*)[0-9]', '\\1') AS stem,
       CASE WHEN feature LIKE 'cm%' OR feature LIKE 'cf%' THEN 'constructed' ELSE 'raw' END AS class
FROM f""")
def feature_names(spark, sf):
    part = table(spark, sf, "part")
    brands = part.select(F.col("p_brand").alias("feature")).distinct()
    cm = part.select(F.concat(F.lit("cm"), "p_size", F.lit("x")).alias("feature")).distinct()
    cf = part.select(F.concat(F.lit("cf"), "p_size").alias("feature")).distinct()
    return po.describe_features(t.catalog(spark, sf).unionByName(brands).unionByName(cm).unionByName(cf))


STEMS_SQL = f"""WITH {t.CATALOG_SQL}, st AS (
  SELECT feature, regexp_extract(feature, '([0-9])', 1) AS wave,
         regexp_replace(feature, '^([^0-9]*)[0-9]', '\\1') AS stem FROM catalog),
g AS (SELECT stem, string_agg(feature, ',' ORDER BY wave, feature) AS columns,
             string_agg(DISTINCT wave, '' ORDER BY wave) AS waves, count(*) AS n_columns
      FROM st GROUP BY stem)"""


@query("stem_groups", STEMS_SQL + " SELECT stem, columns, waves, n_columns FROM g")
def stem_groups(spark, sf):
    g = po.stem_groups(t.catalog(spark, sf))
    return g.select(
        "stem", F.array_join("columns", ",").alias("columns"),
        F.array_join("waves", "").alias("waves"), "n_columns",
    )


@query("wave_sets", STEMS_SQL + """
SELECT CAST(waves AS INT) AS comb, count(*) AS n_stems FROM g WHERE n_columns > 1 GROUP BY 1""")
def wave_sets(spark, sf):
    return po.wave_set_groups(po.stem_groups(t.catalog(spark, sf)))


@query("wave_set_stems", STEMS_SQL + """
SELECT CAST(waves AS INT) AS comb, stem FROM g WHERE n_columns > 1""")
def wave_set_stems(spark, sf):
    return po.stem_wave_sets(po.stem_groups(t.catalog(spark, sf))).select("comb", "stem")


@query("good_bad_sets", STEMS_SQL + """
SELECT count(*) FILTER (n_columns > 1) AS good_sets, count(*) FILTER (n_columns <= 1) AS bad_sets FROM g""")
def good_bad_sets(spark, sf):
    return po.good_bad_sets(po.stem_groups(t.catalog(spark, sf)))


CHUNKS_SQL = STEMS_SQL + """, pl AS (
  SELECT CAST(waves AS INT) AS comb, stem, row_number() OVER (PARTITION BY waves ORDER BY stem) - 1 AS p,
         count(*) OVER (PARTITION BY waves) AS n
  FROM g WHERE n_columns > 1),
k AS (SELECT pl.comb, st.wave AS year, p // 10 AS piece, st.feature, p
      FROM pl JOIN st USING (stem) WHERE (p // 10) * 10 < n - 3),
sets AS (SELECT comb, row_number() OVER (ORDER BY comb) - 1 AS no FROM (SELECT DISTINCT comb FROM pl)),
ch AS (SELECT year, comb, piece, string_agg(feature, ',' ORDER BY p, feature) AS chunk FROM k GROUP BY 1, 2, 3),
chunks AS (SELECT year, comb, row_number() OVER (ORDER BY comb, year, piece) - 1 AS chunk_index,
                  no AS chunk_index_without_year, piece, chunk FROM ch JOIN sets USING (comb))"""


@query("feature_chunks", CHUNKS_SQL + " SELECT * FROM chunks")
def feature_chunks(spark, sf):
    ch = po.feature_chunks(t.catalog(spark, sf), **CHUNK)
    return ch.withColumn("chunk", F.array_join("chunk", ","))


@query("wave_columns", STEMS_SQL + """
SELECT stem, feature FROM st WHERE stem IN (SELECT stem FROM g WHERE n_columns > 1)""")
def wave_columns(spark, sf):
    cat = t.catalog(spark, sf)
    stems = stage(po.stem_wave_sets(po.stem_groups(cat)).select("stem"), "stems")
    return po.wave_columns(cat, stems).select("stem", "feature")


@query("available_chunks", CHUNKS_SQL + """, have AS (
  SELECT DISTINCT concat('m', 1 + p_size % 5, 'q', p_partkey // 5) AS feature FROM part),
e AS (SELECT chunk_index, unnest(string_split(chunk, ',')) AS feature, generate_subscripts(string_split(chunk, ','), 1) AS pos FROM chunks)
SELECT chunk_index, coalesce(string_agg(e.feature, ',' ORDER BY pos) FILTER (h.feature IS NOT NULL), '') AS chunk,
       count(*) FILTER (h.feature IS NULL) AS n_missing
FROM e LEFT JOIN have h ON e.feature = h.feature
GROUP BY chunk_index HAVING count(*) FILTER (h.feature IS NULL) <= 5""")
def available_chunks(spark, sf):
    part = table(spark, sf, "part")
    have = part.select(
        F.concat(F.lit("m"), F.col("p_size") % 5 + 1, F.lit("q"), F.floor(F.col("p_partkey") / 5)).alias("feature")
    )
    ch = po.feature_chunks(t.catalog(spark, sf), **CHUNK)
    out = po.select_available(ch, have, max_missing=5)
    return out.select("chunk_index", F.array_join("chunk", ",").alias("chunk"), "n_missing")


@query("wave_order", f"""WITH {t.CATALOG_SQL}
SELECT feature, regexp_extract(feature, '([0-9])', 1) AS wave,
       row_number() OVER (ORDER BY regexp_extract(feature, '([0-9])', 1), feature) AS ord FROM catalog""")
def wave_order(spark, sf):
    return po.order_by_wave(t.catalog(spark, sf).withColumn("position", F.col("feature")), "position").select(
        "feature", "wave", "ord"
    )


@query("sentinel_clean", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer""")
def sentinel_clean(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", codes.sentinel_to_null("c_acctbal").alias("balance"))


@query("valid_cells", f"""WITH {t.PANEL_SQL}
SELECT feature, count(*) FILTER (value >= 0) AS n_valid, count(*) FILTER (NOT value >= 0) AS n_sentinel
FROM panel GROUP BY feature""")
def valid_cells(spark, sf):
    ok = codes.is_valid("value")
    return t.panel(spark, sf).groupBy("feature").agg(
        F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_sentinel")
    )


SPLIT_SQL = f"""WITH {t.PANEL_SQL}, ids AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
v AS (SELECT id, feature, CASE WHEN value >= 0 THEN value END AS v FROM panel),
m AS (SELECT feature, count(v) AS n_valid, median(v) AS med FROM v GROUP BY feature),
s AS (SELECT feature, n_valid, med, count(*) FILTER (v < med) AS below, count(*) FILTER (v = med) AS equal,
             count(*) FILTER (v > med) AS above
      FROM v JOIN m USING (feature) GROUP BY ALL),
z AS (SELECT *, below < above AS below_smaller, below + CASE WHEN below < above THEN equal ELSE 0 END AS zeros,
             (SELECT n FROM ids) AS n_rows FROM s),
split AS (SELECT *, n_valid - zeros AS ones, (n_rows - n_valid) / n_rows * 100 <= 80 AS dense,
                 zeros >= 40 AND n_valid - zeros >= 40 AS balanced FROM z)"""


def _split(spark, sf, cells):
    n = table(spark, sf, "lineitem").agg(F.count_distinct("l_orderkey")).first()[0]
    return po.median_split(cells, n_rows=n, max_null_percent=80)


@query("median_split", SPLIT_SQL + """
SELECT feature, n_rows, n_valid, round(med, 4) AS median, below, equal, above, zeros, ones,
       CAST(below_smaller AS INT) AS below_smaller, CAST(dense AS INT) AS dense, CAST(balanced AS INT) AS balanced
FROM split""")
def median_split(spark, sf):
    sp = _split(spark, sf, t.stored_panel(spark, sf))
    flags = [F.col(c).cast("int").alias(c) for c in ("below_smaller", "dense", "balanced")]
    return sp.select("feature", "n_rows", "n_valid", r6("median", "median", 4), "below", "equal", "above", "zeros", "ones", *flags)


@query("column_kinds", """WITH c AS (SELECT 'c_nationkey' AS feature, c_nationkey::DOUBLE AS value FROM customer UNION ALL SELECT 'c_acctbal', c_acctbal FROM customer),
v AS (SELECT feature, CASE WHEN value >= 0 THEN value END AS v FROM c),
m AS (SELECT feature, count(*) AS n_rows, count(v) AS n_valid, median(v) AS med FROM v GROUP BY feature),
s AS (SELECT feature, n_rows, n_valid, count(*) FILTER (v < med) AS below, count(*) FILTER (v = med) AS equal, count(*) FILTER (v > med) AS above FROM v JOIN m USING (feature) GROUP BY ALL),
z AS (SELECT *, below + CASE WHEN below < above THEN equal ELSE 0 END AS zeros FROM s)
SELECT (SELECT (count(c_name) > 0)::BIGINT + (count(c_mktsegment) > 0)::BIGINT FROM customer) AS text_columns,
  (SELECT count(*) FROM z WHERE (n_rows - n_valid) / n_rows * 100 <= 99 AND zeros >= 40 AND n_valid - zeros >= 40) AS usable_columns, 4::BIGINT AS n_columns""")
def column_kinds(spark, sf):
    cells = stage(po.melt(table(spark, sf, "customer"), "c_custkey"), "cells")
    return po.column_kinds(cells, po.median_split(cells.where("text IS NULL")))


BITS_SQL = SPLIT_SQL + """, bits AS (
  SELECT id, feature, CASE WHEN v IS NULL THEN NULL
              WHEN v < med OR (below_smaller AND v = med) THEN 0 ELSE 1 END AS value
  FROM v JOIN split USING (feature) WHERE dense AND balanced)"""


@query("binary_cells", BITS_SQL + " SELECT id, feature, CAST(value AS INT) AS value FROM bits")
def binary_cells(spark, sf):
    cells = t.stored_panel(spark, sf)
    return po.binarize_cells(cells, stage(_split(spark, sf, cells), "split")).select("id", "feature", "value")


@query("binarize_panel", BITS_SQL + """
SELECT feature, count(*) FILTER (value = 0) AS zeros, count(*) FILTER (value = 1) AS ones,
       count(*) FILTER (value IS NULL) AS nulls FROM bits GROUP BY feature""")
def binarize_panel(spark, sf):
    return binary_cells(spark, sf).groupBy("feature").agg(
        F.count_if(F.col("value") == 0).alias("zeros"),
        F.count_if(F.col("value") == 1).alias("ones"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    )


@query("numeric_features", """WITH long AS (
  SELECT concat('m', l_linenumber, 'qty') AS feature, CAST(l_quantity AS VARCHAR) AS text FROM lineitem
  UNION ALL SELECT concat('m', l_linenumber, 'flag'), l_returnflag FROM lineitem)
SELECT feature, count(*) AS n_cells, sum(CAST(text AS DOUBLE)) AS total FROM long
WHERE feature NOT IN (SELECT feature FROM long WHERE try_cast(text AS DOUBLE) IS NULL) GROUP BY feature""")
def numeric_features(spark, sf):
    li = table(spark, sf, "lineitem")
    pairs = F.array(
        F.struct(F.concat(F.lit("m"), "l_linenumber", F.lit("qty")).alias("feature"), F.col("l_quantity").cast("string").alias("text")),
        F.struct(F.concat(F.lit("m"), "l_linenumber", F.lit("flag")).alias("feature"), F.col("l_returnflag").alias("text")),
    )
    long = li.select(F.inline(pairs))
    return po.drop_text_columns(long).groupBy("feature").agg(
        F.count("*").alias("n_cells"), F.sum("value").alias("total")
    )


@query("melt_wide", """SELECT c_custkey, 'c_nationkey' AS feature, CAST(c_nationkey AS DOUBLE) AS value, NULL AS text FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal, NULL FROM customer
UNION ALL SELECT c_custkey, 'c_mktsegment', NULL, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'c_name', NULL, c_name FROM customer""")
def melt_wide(spark, sf):
    return po.melt(table(spark, sf, "customer"), "c_custkey")


@query("impute_mean", """SELECT c_custkey,
 round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) OVER ()), 4) AS c_acctbal
FROM customer""")
def impute_mean(spark, sf):
    out = clean.impute_mean(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", r6("c_acctbal", "c_acctbal", 4))


@query("impute_mean_by_segment", """SELECT c_custkey, c_mktsegment,
 round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END,
   avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) OVER (PARTITION BY c_mktsegment)), 4) AS c_acctbal
FROM customer""")
def impute_mean_by_segment(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    out = clean.impute_mean(cust, ["c_acctbal"], by=["c_mktsegment"])
    return out.select("c_custkey", "c_mktsegment", r6("c_acctbal", "c_acctbal", 4))


MODE_CUSTOMERS = "SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nation FROM customer"


def _mode_customers(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation")
    )


@query("impute_mode", f"""WITH c AS ({MODE_CUSTOMERS}),
n AS (SELECT nation, count(*) AS n FROM c WHERE nation IS NOT NULL GROUP BY 1)
SELECT c_custkey, CAST(coalesce(nation, (SELECT nation FROM n ORDER BY n DESC, nation LIMIT 1)) AS DOUBLE) AS nation FROM c""")
def impute_mode(spark, sf):
    return clean.impute_mode(_mode_customers(spark, sf), ["nation"]).select("c_custkey", "nation")


@query("impute_mode_by_segment", f"""WITH c AS ({MODE_CUSTOMERS}),
n AS (SELECT c_mktsegment, nation, count(*) AS n FROM c WHERE nation IS NOT NULL GROUP BY 1, 2),
m AS (SELECT c_mktsegment, nation AS fill FROM n QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, nation) = 1)
SELECT c_custkey, CAST(coalesce(nation, fill) AS DOUBLE) AS nation FROM c LEFT JOIN m USING (c_mktsegment)""")
def impute_mode_by_segment(spark, sf):
    return clean.impute_mode(_mode_customers(spark, sf), ["nation"], by=["c_mktsegment"]).select("c_custkey", "nation")


@query("indicators", """SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT)::DOUBLE AS seg_building,
 CAST(c_mktsegment = 'MACHINERY' AS INT)::DOUBLE AS seg_machinery,
 CAST(c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS INT)::DOUBLE AS seg_others FROM customer""")
def indicators(spark, sf):
    cols = codes.indicators("c_mktsegment", {"seg_building": "BUILDING", "seg_machinery": "MACHINERY"}, "seg_others")
    return table(spark, sf, "customer").select("c_custkey", *cols)


@query("proxy_feature", f"""WITH {t.CELLS_SQL}, wide AS (
  SELECT id, max(CASE WHEN w = 1 AND q >= 0 THEN q END) AS q1, max(CASE WHEN w = 2 AND q >= 0 THEN q END) AS q2,
         max(CASE WHEN w = 3 AND q >= 0 THEN q END) AS q3 FROM cells GROUP BY id)
SELECT id, round((coalesce(q1, avg(q1) OVER ()) + coalesce(q2, avg(q2) OVER ()) + coalesce(q3, avg(q3) OVER ())) / 3, 4) AS proxy
FROM wide""")
def proxy_feature(spark, sf):
    wide = t.cells(spark, sf).groupBy("id").pivot("w", [1, 2, 3]).agg(F.first("q"))
    wide = wide.toDF("id", "q1", "q2", "q3")
    return clean.proxy_feature(wide, ["q1", "q2", "q3"], "proxy").select("id", r6("proxy", "proxy", 4))


@query("baseline_table", """SELECT o_custkey, o_orderkey, o_totalprice AS truth, c_nationkey,
  CAST(c_mktsegment = 'BUILDING' AS INT)::DOUBLE AS seg_building, CAST(c_mktsegment <> 'BUILDING' AS INT)::DOUBLE AS seg_others
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""")
def baseline_table(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    feats = clean.add_indicators(cust, "c_mktsegment", {"seg_building": "BUILDING"}, "seg_others").drop("c_mktsegment")
    outcomes = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("truth")
    )
    known = clean.drop_null_target(outcomes, "truth")
    return lookup_join(known, feats, ["o_custkey"])


@query("label_join", """SELECT c_custkey AS id, c_acctbal AS balance, n_orders FROM
 (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0)
 JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def label_join(spark, sf):
    outcomes = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), codes.sentinel_to_null("c_acctbal").alias("balance")
    )
    feats = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    return clean.label_join(outcomes, stage(feats, "features"), "id", "balance")


@query("read_prefix", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100")
def read_prefix(spark, sf):
    cust = files.read_table(spark, f"{sf}/customer.parquet").drop("c_nationkey", "c_mktsegment")
    return report.head(files.read_prefix(cust, 100, "c_custkey"), 100, "c_custkey")


@query("keep_ids", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (13, 14, 16) OR o_custkey IN (SELECT c_custkey + 1 FROM customer WHERE c_acctbal < 0)""")
def keep_ids(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    debtors = clean.rekey(
        table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"), "c_custkey", "o_custkey"
    )
    listed = spark.createDataFrame([(13,), (14,), (16,)], "o_custkey long")
    return clean.keep_ids(orders, "o_custkey", debtors.unionByName(listed))


@query("keep_listed_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (12, 13, 15)")
def keep_listed_ids(spark, sf):
    return clean.keep_ids(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", [12, 13, 15])


@query("rekey_owner", """SELECT event_id, event_id // 2000 AS owner, user_id + 1 AS challengeID FROM events""")
def rekey_owner(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").alias("family_id"))
    return clean.rekey(ev.withColumn("owner", clean.owner_of_line("event_id")))


@query("owner_lines", """SELECT DISTINCT event_id // 2000 AS owner, event_id // 2000 * 2000 AS first_line,
 event_id // 2000 * 2000 + 1999 AS last_line FROM events""")
def owner_lines(spark, sf):
    owners = table(spark, sf, "events").select(clean.owner_of_line("event_id").alias("owner")).distinct()
    return clean.lines_of_owner(owners, "owner")


@query("outlier_filter", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 0 AND n_chars < 2000")
def outlier_filter(spark, sf):
    return clean.drop_outliers(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 0, 2000)


@query("outlier_list", """SELECT doc_id, n_chars, CAST((SELECT count(*) FROM documents WHERE n_chars > 200) AS BIGINT) AS n_outliers
FROM documents WHERE n_chars > 200""")
def outlier_list(spark, sf):
    out = clean.list_outliers(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    return out.withColumn("n_outliers", out.agg(F.count("*")).scalar())


@query("drop_any_null", f"WITH c AS ({MODE_CUSTOMERS}) SELECT c_custkey, nation FROM c WHERE nation IS NOT NULL AND c_mktsegment <> 'BUILDING'")
def drop_any_null(spark, sf):
    rows = _mode_customers(spark, sf).withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    )
    return clean.drop_any_null(rows).select("c_custkey", "nation")


@query("side_by_side", """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
 round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END) OVER ()), 4) AS balance_imp
FROM customer""")
def side_by_side(spark, sf):
    from ..operators.labels import side_by_side as join

    cust = table(spark, sf, "customer").select("c_custkey", codes.sentinel_to_null("c_acctbal").alias("balance"))
    both = join(cust, clean.impute_mean(cust, ["balance"]), "c_custkey")
    return both.withColumn("balance_imp", F.round("balance_imp", 4))


@query("parse_list", STEMS_SQL + " SELECT stem, columns, n_columns FROM g")
def parse_list(spark, sf):
    g = po.stem_groups(t.catalog(spark, sf))
    printed = g.select(
        "stem",
        F.concat(
            F.lit("["), F.array_join(F.transform("columns", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]")
        ).alias("printed"),
    )
    parsed = printed.withColumn("parsed", arrays.parse_list_literal("printed"))
    return parsed.select("stem", F.array_join("parsed", ",").alias("columns"), F.size("parsed").cast("bigint").alias("n_columns"))
