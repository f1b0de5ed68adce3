"""Residuals, scores, ensembles, grids, vectors, models and files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays, codes, draws
from ..operators import clean, evaluate, imputation, labels, models, report, sampling, textrows, vectors
from ..operators.joins import fan_out, lookup_join
from ..plans import jobs
from ..sources import files
from ..sources.staging import new_path, stage
from . import tables as t
from .panel_queries import SPLIT_SQL
from .registry import query, r6, table

RES = t.RESIDUAL_SQL


@query("residuals", f"""WITH {RES} SELECT id, task, truth, prediction, diff, prediction + diff / 2 AS new_prediction FROM residuals WHERE truth IS NOT NULL""")
def residuals(spark, sf):
    res = evaluate.with_residual(t.residuals(spark, sf)).withColumn("half", F.col("diff") / 2)
    out = evaluate.apply_correction(res, diff="half")
    return out.select("id", "task", "truth", "prediction", "diff", "new_prediction")


@query("holdout_r2", f"WITH {RES} SELECT task, round({t.r2_sql('prediction', 'truth', 'm')}, 6) AS R FROM (SELECT *, avg(ybar_train) OVER (PARTITION BY task) AS m FROM residuals WHERE truth IS NOT NULL) GROUP BY task")
def holdout_r2(spark, sf):
    return evaluate.r2_by(t.residuals(spark, sf), ["task"]).select("task", r6("R", "R"))


@query("holdout_r2_from_train", f"""WITH {RES}, m AS (
  SELECT o_orderpriority AS task, avg(cents) AS m FROM priced WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT task, round({t.r2_sql('prediction', 'truth', 'm')}, 6) AS R FROM residuals JOIN m USING (task) WHERE truth IS NOT NULL GROUP BY task""")
def holdout_r2_from_train(spark, sf):
    train = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_orderpriority").alias("task"), F.round(F.col("o_totalprice") * 100).alias("cents")
    )
    out = evaluate.r2_from_train(t.residuals(spark, sf), train, ["task"], "prediction", "truth", "cents")
    return out.select("task", r6("R", "R"))


@query("mae", f"WITH {RES} SELECT task, round(avg(abs(prediction - truth)), 4) AS mae FROM residuals GROUP BY task")
def mae(spark, sf):
    return t.residuals(spark, sf).groupBy("task").agg(r6(evaluate.mae("prediction", "truth"), "mae", 4))


@query("corr_pred_gold", f"WITH {RES} SELECT task, round(corr(prediction, truth), 6) AS corr FROM residuals GROUP BY task")
def corr_pred_gold(spark, sf):
    out = evaluate.corr_pred_gold(t.residuals(spark, sf), ["task"], "prediction", "truth")
    return out.select("task", r6("corr", "corr"))


@query("accuracy", """WITH l AS (SELECT l_linenumber AS task, [l_discount, l_tax, 0.05::DOUBLE] AS logits,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)
SELECT task, round(avg(CASE WHEN list_position(logits, list_max(logits)) - 1 = label THEN 1.0 ELSE 0 END), 6) AS accuracy FROM l GROUP BY task""")
def accuracy(spark, sf):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    logits = F.array("l_discount", "l_tax", F.lit(0.05))
    out = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("task")).agg(
        evaluate.accuracy(logits, flag).alias("accuracy")
    )
    return out.select("task", r6("accuracy", "accuracy"))


@query("five_number", f"""WITH {RES} SELECT task, round(min(diff), 3) AS min, round(median(diff), 3) AS median, round(max(diff), 3) AS max,
 round(avg(diff), 3) AS mean, round(stddev_pop(diff), 3) AS std_pop FROM residuals GROUP BY task""")
def five_number(spark, sf):
    res = stage(t.residuals(spark, sf).select("task", "diff"), "diffs")
    out = evaluate.five_number(res, ["task"], "diff")
    return out.select("task", *[r6(c, c, 3) for c in ("min", "median", "max", "mean", "std_pop")])


@query("label_stats", """SELECT min(n_chars)::DOUBLE AS min, median(n_chars) AS median, max(n_chars)::DOUBLE AS max,
 round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS std_pop FROM documents""")
def label_stats(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("n_chars"))
    out = evaluate.five_number(docs, [], "n_chars")
    return out.select("min", "median", "max", r6("mean", "mean", 4), r6("std_pop", "std_pop", 4))


DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_samp,
 min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS p50,
 round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM customer"""


@query("describe", DESCRIBE.format(c="c_acctbal") + " UNION ALL " + DESCRIBE.format(c="c_nationkey") + " UNION ALL " + DESCRIBE.format(c="c_custkey"))
def describe(spark, sf):
    out = evaluate.describe(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey", "c_custkey"])
    return out.select("column", "count", *[r6(c, c, 4) for c in ("mean", "std_samp", "min", "p25", "p50", "p75", "max")])


@query("select_benchmark", """WITH b AS (SELECT o_orderkey, o_orderpriority AS outcome,
  CASE WHEN o_orderstatus = 'F' THEN 'benchmark_ols_full' ELSE 'benchmark_logit_full' END AS account FROM orders)
SELECT * FROM b WHERE account = CASE WHEN outcome IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'benchmark_ols_full' ELSE 'benchmark_logit_full' END""")
def select_benchmark(spark, sf):
    b = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("outcome"),
        F.when(F.col("o_orderstatus") == "F", codes.OLS_ACCOUNT).otherwise(codes.LOGIT_ACCOUNT).alias("account"),
    )
    return evaluate.select_benchmark(b, ols_tasks=["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("mean_median_ensemble", """SELECT user_id AS id, count(*) AS n_rows, avg(round(value * 100)) AS mean_diff, median(round(value * 100)) AS median_diff
FROM events GROUP BY 1""")
def mean_median_ensemble(spark, sf):
    return evaluate.mean_and_median_per_id(t.user_scores(spark, sf), ["id"], "score")


@query("mean_median_r2", f"""WITH {t.USER_SQL}, e AS (SELECT id, avg(score) AS a, median(score) AS b FROM user_scores GROUP BY 1),
j AS (SELECT * FROM user_residuals JOIN e USING (id)),
s AS (SELECT task, {t.r2_sql('prediction', 'truth', 'ybar_train')} AS r0, {t.r2_sql('(prediction + a)', 'truth', 'ybar_train')} AS r1,
       {t.r2_sql('(prediction + b)', 'truth', 'ybar_train')} AS r2 FROM j GROUP BY task)
SELECT task, round(r0, 6) AS R_base, round(r1, 6) AS R_mean, round(r2, 6) AS R_median, round(r1 - r0, 6) AS gain_mean, round(r2 - r0, 6) AS gain_median FROM s""")
def mean_median_r2(spark, sf):
    both = evaluate.mean_and_median_per_id(t.user_scores(spark, sf), ["id"], "score")
    joined = t.user_residuals(spark, sf).join(both, "id")
    out = evaluate.compare_with_baseline(joined, ["task"], {"mean": "mean_diff", "median": "median_diff"})
    return out.select("task", *[r6(c, c) for c in out.columns if c != "task"])


@query("best_pick", f"""WITH {t.USER_SQL}, r AS (SELECT id, task, event_id, score, diff FROM user_scores JOIN user_residuals USING (id))
SELECT id, task, score AS best FROM r QUALIFY row_number() OVER (PARTITION BY id, task ORDER BY abs(score - diff), event_id) = 1""")
def best_pick(spark, sf):
    rows = fan_out(t.user_scores(spark, sf), t.user_residuals(spark, sf).select("id", "task", "diff"), ["id"])
    return evaluate.best_pick(rows, ["id", "task"], "score", "diff", "event_id")


GRID_SQL = f"""WITH {RES}, {t.SCORES_SQL}, m AS (SELECT id, chunk_index, avg(score) AS d FROM scores GROUP BY 1, 2),
j AS (SELECT task, chunk_index, prediction + d AS p, truth, avg(CASE WHEN truth IS NOT NULL THEN ybar_train END) OVER (PARTITION BY task, chunk_index) AS ybar
      FROM m JOIN residuals USING (id) WHERE truth IS NOT NULL),
grid AS (SELECT task, chunk_index, {t.r2_sql('p', 'truth', 'ybar')} AS R FROM j GROUP BY 1, 2),
dim AS (SELECT DISTINCT chunk_index, chunk_index // 3 + 1 AS year, chunk_index % 3 AS chunk_index_without_year FROM scores),
zero AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS task, unnest([0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS b),
gains AS (SELECT task, chunk_index, year, chunk_index_without_year, R, R - b AS gain FROM grid JOIN dim USING (chunk_index) JOIN zero USING (task))"""
BASELINE = {"1-URGENT": 0.1, "2-HIGH": 0.2, "3-MEDIUM": 0.3, "4-NOT SPECIFIED": 0.4, "5-LOW": 0.5}


def _grid(spark, sf):
    res = stage(t.residuals(spark, sf), "residuals")
    return evaluate.evaluate_grid(t.task_scores(spark, sf, res), res)


def _gains(spark, sf):
    chunks = stage(t.chunk_dim(spark, sf), "chunk_dim")
    return report.subtract_baseline(report.attach_chunks(_grid(spark, sf), chunks), BASELINE)


@query("evaluate_grid", GRID_SQL + " SELECT task, chunk_index, round(R, 6) AS R FROM grid")
def evaluate_grid(spark, sf):
    return _grid(spark, sf).select("task", "chunk_index", r6("R", "R"))


@query("grid_gains", GRID_SQL + " SELECT task, chunk_index, year, chunk_index_without_year, round(R, 6) AS R, round(gain, 6) AS gain FROM gains")
def grid_gains(spark, sf):
    return _gains(spark, sf).select(
        "task", "chunk_index", "year", "chunk_index_without_year", r6("R", "R"), r6("gain", "gain")
    )


@query("score_grid", GRID_SQL + """ SELECT task, year, round(max(gain) FILTER (chunk_index_without_year = 0), 6) AS "0",
 round(max(gain) FILTER (chunk_index_without_year = 1), 6) AS "1", round(max(gain) FILTER (chunk_index_without_year = 2), 6) AS "2"
FROM gains GROUP BY task, year""")
def score_grid(spark, sf):
    gains = _gains(spark, sf).withColumn("gain", F.round("gain", 6))
    return report.score_grid(gains, [0, 1, 2], list(t.WAVES))


@query("grid_range", GRID_SQL + " SELECT task, round(min(gain), 6) AS low, round(max(gain), 6) AS high FROM gains GROUP BY task")
def grid_range(spark, sf):
    return report.grid_range(_gains(spark, sf)).select("task", r6("low", "low"), r6("high", "high"))


@query("pivot_chunks", GRID_SQL + " SELECT id, task, " + ", ".join(
    f'max(d) FILTER (chunk_index = {i}) AS "{i}"' for i in range(t.N_SCORE_CHUNKS)
) + " FROM m JOIN residuals USING (id) GROUP BY id, task")
def pivot_chunks(spark, sf):
    res = stage(t.residuals(spark, sf), "residuals")
    means = evaluate.mean_per_id(t.task_scores(spark, sf, res), ["id", "task", "chunk_index"], "score")
    return report.pivot_chunk_predictions(means, range(t.N_SCORE_CHUNKS))


@query("prediction_joins", GRID_SQL + """ SELECT m.id, task, chunk_index, d AS predicted_diff, diff
FROM m JOIN residuals USING (id)""")
def prediction_joins(spark, sf):
    res = stage(t.residuals(spark, sf), "residuals")
    means = stage(evaluate.mean_per_id(t.task_scores(spark, sf, res), ["id", "task", "chunk_index"], "score"), "means")
    return labels.chunk_prediction_table(means, res)


@query("chunk_regression_cells", f"""WITH {t.PANEL_SQL}, {RES}, {t.TWO_TASKS_SQL}
SELECT (p.ord - 1) // 7 AS chunk_index, p.id, p.feature, p.value, r.task, r.diff FROM panel p JOIN two_tasks r USING (id)""")
def chunk_regression_cells(spark, sf):
    cells, chunks = _chunked(spark, sf)
    diffs = stage(t.two_tasks(spark, sf), "diffs")
    return labels.chunk_regression_cells(cells, chunks, diffs)


def _chunked(spark, sf):
    cells = t.panel(spark, sf)
    size = 7
    chunks = spark.createDataFrame(
        [(i // size, t.PANEL_FEATURES[i : i + size]) for i in range(0, len(t.PANEL_FEATURES), size)],
        "chunk_index long, chunk array<string>",
    )
    return cells.select("id", "feature", "value"), chunks


@query("stack_results", f"""WITH {RES} SELECT 'all' AS part, task, count(*) AS n FROM residuals GROUP BY task
UNION ALL SELECT 'known', task, count(*) FROM residuals WHERE truth IS NOT NULL GROUP BY task""")
def stack_results(spark, sf):
    res = t.residuals(spark, sf)
    count = F.count("*").alias("n")
    parts = {"all": res.groupBy("task").agg(count), "known": evaluate.with_residual(res).groupBy("task").agg(count)}
    return report.stack_results(parts, "part").select("part", "task", "n")


# Vectors.

DIM = 64
LONG_SQL = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)"""


@query("parse_vector", """SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total,
 embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings""")
def parse_vector(spark, sf):
    emb = table(spark, sf, "embeddings")
    printed = emb.select("vec_id", arrays.print_vector(F.col("embedding").cast("array<double>")).alias("emb"))
    v = printed.select("vec_id", arrays.parse_vector("emb").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return v.select(
        "vec_id", F.size("v").cast("bigint").alias("dims"), r6(total, "total"),
        F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(DIM - 1)).alias("last"),
    )


@query("centroid_dispersion", f"""WITH {LONG_SQL}, c AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2),
n AS (SELECT e.vec_id, label, sqrt(sum((x - m) * (x - m))) AS dist FROM e JOIN c USING (label, d) GROUP BY 1, 2)
SELECT label, count(*) AS n_rows, round(avg(dist), 6) AS dispersion FROM n GROUP BY label""")
def centroid_dispersion(spark, sf):
    out = vectors.centroid_dispersion(table(spark, sf, "embeddings"), ["label"], "embedding")
    return out.select("label", "n_rows", r6("dispersion", "dispersion"))


def draws_sql(source: str, m: str, n: int, keys: str, out: str) -> str:
    """CTEs ``out``: n distinct positions below ``m`` for each row of ``source``.

    Positions 0..n-1 pass a keyed permutation of an a x b grid, again and
    again until they are below m.
    """
    def mixed(i: int, side: str, other: str, size: str, inner: str) -> str:
        key = f"md5(concat_ws(':', '5', kind, {keys}, {i}, {other}))"
        return f"(SELECT * REPLACE (({side} + ('0x' || substr({key}, 1, 12))::BIGINT % {size}) % {size} AS {side}) FROM {inner})"

    turned = f"(SELECT *, x // b AS l, x % b AS r FROM {out}_w WHERE NOT begun OR x >= m)"
    for i in range(draws.ROUNDS):
        turned = mixed(i, "l", "r", "a", turned) if i % 2 == 0 else mixed(i, "r", "l", "b", turned)
    return f"""{out}_s AS (SELECT *, CAST(ceil(sqrt({m})) AS BIGINT) AS a FROM {source}),
{out}_d AS (SELECT kind, {keys}, {m} AS m, a, ({m} + a - 1) // a AS b, unnest(range({n})) AS x FROM {out}_s),
{out}_w AS (SELECT *, FALSE AS begun FROM {out}_d
  UNION ALL SELECT kind, {keys}, m, a, b, l * b + r AS x, TRUE AS begun FROM {turned}),
{out} AS (SELECT {keys}, x AS pos FROM {out}_w WHERE begun AND x < m)"""


# Groups of the test vectors have 42 rows and more, and there are ten of them.
N_SAME, REPEATS, N_MIXED = 40, sampling.SAMPLE_REPEATS, 8
NUMBERED = """nr AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings),
sz AS (SELECT label, count(*) AS m FROM embeddings GROUP BY label)"""


def same_sql(n: int) -> str:
    """CTEs down to ``same`` (label, repeat, vec_id)."""
    return f"""same_src AS (SELECT 'same' AS kind, label, m, unnest(range(1, {REPEATS + 1})) AS repeat FROM sz),
{draws_sql('same_src', 'm', n, 'label, repeat', 'same_pick')},
same AS (SELECT label, repeat, vec_id FROM same_pick JOIN nr USING (label, pos))"""


def mixed_sql(n: int) -> str:
    """CTEs down to ``mixed`` (sample_no, label, vec_id)."""
    return f"""idn AS (SELECT label, m, row_number() OVER (ORDER BY label) - 1 AS id_no FROM sz),
mixed_src AS (SELECT 'mixed' AS kind, (SELECT count(*) FROM sz) AS m, id_no * {REPEATS} + r AS sample_no FROM idn, (SELECT unnest(range(1, {REPEATS + 1})) AS r)),
{draws_sql('mixed_src', 'm', n, 'sample_no', 'mixed_pick')},
placed AS (SELECT sample_no, label, ('0x' || substr(md5(concat_ws(':', '5', 'row', sample_no, label)), 1, 12))::BIGINT % m AS pos
           FROM mixed_pick JOIN idn ON id_no = mixed_pick.pos),
mixed AS (SELECT sample_no, label, vec_id FROM placed JOIN nr USING (label, pos))"""


SAME_CTES, MIXED_CTES = same_sql(N_SAME), mixed_sql(N_MIXED)
SAME_SQL = f"WITH RECURSIVE {NUMBERED}, {SAME_CTES}"
MIXED_SQL = f"WITH RECURSIVE {NUMBERED}, {MIXED_CTES}"


@query("same_id_samples", SAME_SQL + " SELECT label, repeat, vec_id FROM same")
def same_id_samples(spark, sf):
    return sampling.same_id_samples(table(spark, sf, "embeddings"), "label", "vec_id", N_SAME, REPEATS, 5)


@query("mixed_id_samples", MIXED_SQL + " SELECT sample_no, label, vec_id FROM mixed")
def mixed_id_samples(spark, sf):
    return sampling.mixed_id_samples(table(spark, sf, "embeddings"), "label", "vec_id", N_MIXED, REPEATS, 5)


# The operators' own sizes, on lines: a group is a return flag, or a flag and a quantity.
SIZES = """sz AS (SELECT label, count(*) AS m FROM lines GROUP BY label),
nr AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM lines)"""


@query("same_id_lines", f"""WITH RECURSIVE lines AS (SELECT l_returnflag AS label, l_orderkey * 8 + l_linenumber AS vec_id FROM lineitem),
{SIZES}, {same_sql(sampling.SAMPLE_ROWS)}
SELECT label, repeat, count(*) AS n, count(DISTINCT vec_id) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS total FROM same GROUP BY ALL""")
def same_id_lines(spark, sf):
    lines = _lines(spark, sf, F.col("l_returnflag"))
    out = sampling.same_id_samples(lines, "label", "vec_id", seed=5)
    return _sample_sums(out, ["label", "repeat"], "vec_id")


@query("mixed_id_lines", f"""WITH RECURSIVE lines AS (SELECT concat(l_returnflag, CAST(l_quantity AS BIGINT)) AS label, l_orderkey * 8 + l_linenumber AS vec_id FROM lineitem),
{SIZES}, {mixed_sql(sampling.SAMPLE_ROWS)}
SELECT sample_no, count(*) AS n, count(DISTINCT label) AS n_rows, CAST(sum(vec_id) AS BIGINT) AS total FROM mixed GROUP BY ALL""")
def mixed_id_lines(spark, sf):
    lines = _lines(spark, sf, F.concat("l_returnflag", F.col("l_quantity").cast("bigint").cast("string")))
    out = sampling.mixed_id_samples(lines, "label", "vec_id", seed=5)
    return _sample_sums(out, ["sample_no"], "label")


def _lines(spark, sf, label):
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint")
    return table(spark, sf, "lineitem").select(label.alias("label"), line.alias("vec_id"))


def _sample_sums(samples, keys, distinct):
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(distinct).alias("n_rows"), F.sum("vec_id").alias("total")
    )


def _dispersion_sql(samples: str, keys: str) -> str:
    """CTEs down to ``<samples>_disp`` (keys, n_rows, dispersion)."""
    p = samples
    return f"""{p}_v AS (SELECT {keys}, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
  FROM (SELECT {keys}, vec_id FROM {samples}) JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id)),
{p}_c AS (SELECT {keys}, d, avg(x) AS m FROM {p}_v GROUP BY ALL),
{p}_n AS (SELECT {keys}, vec_id, sqrt(sum((x - m) * (x - m))) AS dist FROM {p}_v JOIN {p}_c USING ({keys}, d) GROUP BY ALL),
{p}_disp AS (SELECT {keys}, count(*) AS n_rows, avg(dist) AS dispersion FROM {p}_n GROUP BY ALL)"""


def _dispersions(spark, sf, kind: str):
    emb = table(spark, sf, "embeddings")
    if kind == "same":
        samples, keys = same_id_samples(spark, sf), ["label", "repeat"]
    else:
        samples, keys = mixed_id_samples(spark, sf).drop("label"), ["sample_no"]
    return sampling.sample_dispersion(samples, keys, emb, "vec_id", "embedding", DIM)


@query("same_dispersion", SAME_SQL + ", " + _dispersion_sql("same", "label, repeat") + """
SELECT label, repeat, n_rows, round(dispersion, 6) AS dispersion FROM same_disp""")
def same_dispersion(spark, sf):
    return _dispersions(spark, sf, "same").withColumn("dispersion", F.round("dispersion", 6))


@query("mixed_dispersion", MIXED_SQL + ", " + _dispersion_sql("mixed", "sample_no") + """
SELECT sample_no, n_rows, round(dispersion, 6) AS dispersion FROM mixed_disp""")
def mixed_dispersion(spark, sf):
    return _dispersions(spark, sf, "mixed").withColumn("dispersion", F.round("dispersion", 6))


@query("dispersion_histogram", SAME_SQL + ", " + _dispersion_sql("same", "label, repeat") + """
SELECT CAST(floor(dispersion / 0.02) AS BIGINT) AS bin, count(*) AS n, round(CAST(floor(dispersion / 0.02) AS BIGINT) * 0.02::DOUBLE, 6) AS bin_start
FROM same_disp GROUP BY ALL""")
def dispersion_histogram(spark, sf):
    out = vectors.histogram(_dispersions(spark, sf, "same"), "dispersion", 0.02)
    return out.withColumn("bin_start", F.round("bin_start", 6))


@query("same_vs_mixed", SAME_SQL + ", " + MIXED_CTES + ", " + _dispersion_sql("same", "label, repeat") + ", "
       + _dispersion_sql("mixed", "sample_no") + """,
both_kinds AS (SELECT 'same' AS kind, dispersion AS x FROM same_disp UNION ALL SELECT 'mixed', dispersion FROM mixed_disp)
SELECT kind, round(min(x), 6) AS min, round(median(x), 6) AS median, round(max(x), 6) AS max, round(avg(x), 6) AS mean,
  round(stddev_pop(x), 6) AS std_pop FROM both_kinds GROUP BY kind""")
def same_vs_mixed(spark, sf):
    parts = {k: _dispersions(spark, sf, k).select("dispersion") for k in ("same", "mixed")}
    both = stage(report.stack_results(parts, "kind"), "dispersions")
    out = evaluate.five_number(both, ["kind"], "dispersion")
    return out.select("kind", *[r6(c, c) for c in ("min", "median", "max", "mean", "std_pop")])


@query("mean_pool", """WITH k AS (SELECT label, unnest(range(1, 9)) AS d, embedding FROM embeddings),
r AS (SELECT label, d, list_avg(list_transform(range(0, 8), lambda j: embedding[j * 8 + d]::DOUBLE)) AS x FROM k),
m AS (SELECT label, d, avg(x) AS x FROM r GROUP BY 1, 2)
SELECT label, d, round(x, 6) AS x FROM m""")
def mean_pool(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice(F.col("embedding"), j * 8 + 1, 8))
    rows = table(spark, sf, "embeddings").select("label", tokens.alias("tokens"))
    pooled = vectors.mean_pool(rows, ["label"], "tokens")
    return pooled.select("label", F.posexplode("embedding").alias("d", "x")).select(
        "label", (F.col("d") + 1).cast("bigint").alias("d"), r6("x", "x")
    )


@query("matrix_per_id", """WITH n AS (SELECT conv_id, turn, role, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM conversations)
SELECT conv_id, (no - 1) // 3 AS block_no, count(*) AS n_rows, string_agg(CAST(size AS VARCHAR), ' ' ORDER BY no) AS matrix,
 (SELECT role FROM n f WHERE f.conv_id = n.conv_id AND f.no = 1) AS role FROM n GROUP BY conv_id, (no - 1) // 3""")
def matrix_per_id(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("size"))
    out = vectors.matrix_blocks(conv, "conv_id", "turn", "size", "role", block_rows=3)
    return out.withColumn("matrix", F.array_join(F.col("matrix").cast("array<string>"), " "))


# Models.


@query("ols_baseline", """WITH tr AS (SELECT o_totalprice AS y, c_acctbal AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM tr),
te AS (SELECT o_totalprice AS y, c_acctbal AS x FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
SELECT count(*) AS n_test, round(max(a), 3) AS intercept, round(max(b), 6) AS slope,
 round(1 - sum((a + b * x - y) * (a + b * x - y)) / sum((m - y) * (m - y)), 6) AS R FROM te, f""")
def ols_baseline(spark, sf):
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("x"))
    rows = lookup_join(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.col("o_totalprice").alias("y")), cust, ["o_custkey"])
    train, test = rows.where("o_orderstatus <> 'P'"), rows.where("o_orderstatus = 'P'")
    model = models.ols(train, ["x"], "y")
    scored = models.predict(model, test, ["x"])
    r2 = evaluate.r2_from_train(scored, train, [], "prediction", "y", "y")
    return r2.select(
        scored.agg(F.count("*")).scalar().alias("n_test"),
        F.lit(round(model.intercept, 3)).alias("intercept"),
        F.lit(round(float(model.coefficients[0]), 6)).alias("slope"),
        r6("R", "R"),
    )


@query("linear_baseline")
def linear_baseline(spark, sf):
    """The baseline job: coded features, indicators, proxy, OLS, predictions."""
    li = table(spark, sf, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    background = li.groupBy(F.col("l_orderkey").alias("challengeID")).agg(
        F.max("l_linenumber").alias("cm1ethrace"),
        (F.max("l_quantity") - 3).alias("cm1edu"),
        F.max(flag).alias("cm1relf"),
        *[(F.avg(c) - 0.01).alias(n) for c, n in zip(("l_tax", "l_discount", "l_quantity"), clean.GPA_PROXY_COLUMNS)],
    )
    feats = stage(jobs.baseline_features(background), "features")
    outcomes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("challengeID"), F.col("o_totalprice").alias("gpa"))
    split = sampling.hash_split(outcomes, ["challengeID"], 0.1, 1)
    train, test = (split.where(F.col("split") == s) for s in ("train", "test"))
    cols = ["race_black", "race_hispanic", "cm1edu", "marital_married", "marital_cohab", "gpa_proxy"]
    return jobs.linear_baseline(feats, train, test, "challengeID", "gpa", cols)


WEIGHTS = [((i * 7) % 11 - 5) / 10 for i in range(DIM)]


@query("score_batches", f"""SELECT vec_id, round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: embedding[i]::DOUBLE * ((i - 1) * 7 % 11 - 5) / 10)) + 0.5, 6) AS score
FROM embeddings""")
def score_batches(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = models.score_batches(emb, models.linear_scorer("embedding", WEIGHTS, 0.5))
    return out.select("vec_id", r6("score", "score"))


def _gappy(spark, sf):
    """Customers whose negative balances are gaps, and gaps in nation group."""
    cust = table(spark, sf, "customer")
    keep = F.col("c_acctbal") >= 0
    return cust.select(
        "c_custkey",
        F.length("c_mktsegment").cast("double").alias("size"),
        F.when(keep, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") > 1, F.col("c_nationkey") % 3).cast("double").alias("grp"),
    )


@query("impute_pmm", """WITH c AS (SELECT c_custkey, length(c_mktsegment)::DOUBLE AS size, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance FROM customer),
f AS (SELECT regr_slope(balance, size) AS b, regr_intercept(balance, size) AS a FROM c),
p AS (SELECT c.*, a + b * size AS pred FROM c, f),
w AS (SELECT *, last_value(balance IGNORE NULLS) OVER lo AS lv, last_value(CASE WHEN balance IS NOT NULL THEN pred END IGNORE NULLS) OVER lo AS lp,
             first_value(balance IGNORE NULLS) OVER hi AS uv, first_value(CASE WHEN balance IS NOT NULL THEN pred END IGNORE NULLS) OVER hi AS up
      FROM p WINDOW lo AS (ORDER BY pred, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    hi AS (ORDER BY pred, c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT c_custkey, coalesce(balance, CASE WHEN up IS NULL OR (lp IS NOT NULL AND pred - lp <= up - pred) THEN lv ELSE uv END) AS balance FROM w""")
def impute_pmm(spark, sf):
    filled = imputation.impute_pmm(_gappy(spark, sf).drop("grp"), "c_custkey", "balance", ["size"])
    return filled.select("c_custkey", "balance")


@query("impute_chained")
def impute_chained(spark, sf):
    return imputation.impute_chained(
        _gappy(spark, sf), "c_custkey", {"grp": "multinomial logistic", "balance": "least squares"}, ["size"]
    )


def _chained_sql(copies: int, rounds: int) -> str:
    """Normal equations of two columns that predict each other, beside ``size``."""
    def normal(step: int, c: str) -> str:
        u, v = (f"('0x' || substr(md5(concat_ws(':', '0', copy_no, {step}, '{c}', c_custkey, '{w}')), 1, 12))::BIGINT" for w in "uv")
        return f"sqrt(-2 * ln(({u} + 1) / (pow(2, 48) + 1))) * cos({v} / pow(2, 48) * 2 * pi())"

    ctes = ["""c0 AS (SELECT c_custkey, length(c_mktsegment)::DOUBLE AS size, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
  CASE WHEN c_nationkey > 1 THEN c_nationkey::DOUBLE END AS nation FROM customer)""",
            f"""t0 AS (SELECT unnest(range(1, {copies + 1})) AS copy_no, c_custkey, size, coalesce(balance, (SELECT avg(balance) FROM c0)) AS balance,
  coalesce(nation, (SELECT avg(nation) FROM c0)) AS nation, balance IS NULL AS no_balance, nation IS NULL AS no_nation FROM c0)"""]
    at = 0
    for step in range(1, rounds + 1):
        for y, o in (("balance", "nation"), ("nation", "balance")):
            ctes.append(f"""f{at} AS (SELECT copy_no, (cxy * vo - coy * cxo) / (vx * vo - cxo * cxo) AS b, (coy * vx - cxy * cxo) / (vx * vo - cxo * cxo) AS d, *
  FROM (SELECT copy_no, avg(size) AS mx, avg({o}) AS mo, avg({y}) AS my, var_pop(size) AS vx, var_pop({o}) AS vo, var_pop({y}) AS vy,
    covar_pop(size, {y}) AS cxy, covar_pop({o}, {y}) AS coy, covar_pop(size, {o}) AS cxo FROM t{at} WHERE NOT no_{y} GROUP BY copy_no))""")
            ctes.append(f"""t{at + 1} AS (SELECT t.* REPLACE (CASE WHEN no_{y} THEN my + b * (size - mx) + d * ({o} - mo) + sqrt(vy - b * cxy - d * coy) * {normal(step, y)} ELSE {y} END AS {y})
  FROM t{at} t JOIN (SELECT copy_no, mx, mo, my, vy, b, d, cxy, coy FROM f{at}) USING (copy_no))""")
            at += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT copy_no, c_custkey, size, round(balance, 4) AS balance, round(nation, 6) AS nation FROM t{at}"


@query("impute_chained_linear", _chained_sql(5, 3))
def impute_chained_linear(spark, sf):
    cust = table(spark, sf, "customer").select(
        "c_custkey", F.length("c_mktsegment").cast("double").alias("size"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") > 1, F.col("c_nationkey")).alias("nation"),
    )
    out = imputation.impute_chained(cust, "c_custkey", {"balance": "least squares", "nation": "least squares"}, ["size"])
    return out.select("copy_no", "c_custkey", "size", r6("balance", "balance", 4), r6("nation", "nation"))


# Files.


@query("collect_results", GRID_SQL + " SELECT task, CAST(chunk_index AS VARCHAR) AS chunk_index, round(R, 6) AS R FROM grid")
def collect_results(spark, sf):
    grid = stage(_grid(spark, sf).withColumn("R", F.round("R", 6)), "grid")
    root = new_path(spark, "results")
    out = grid.select("task", F.lit("mean").alias("strategy"), "chunk_index", F.col("R").cast("string").alias("value"))
    files.write_partitioned(out, root, ["task", "strategy", "chunk_index"], "text")
    return files.collect_results(spark, root, ["task", "chunk_index"], "task=([^/]+)/strategy=[^/]+/chunk_index=([^/]+)", grid)


@query("io_roundtrip_csv", "SELECT doc_id, text, lang, n_chars FROM documents")
def io_roundtrip_csv(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    path = new_path(spark, "csv")
    files.write_csv(docs, path)
    return files.read_table(spark, path, docs.schema, na_texts=())


@query("io_records_indexed", "SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rec_no FROM conversations QUALIFY row_number() OVER (ORDER BY conv_id, turn) % 20 = 0")
def io_records_indexed(spark, sf):
    """Every 20th record of a CSV file whose fields span lines."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text").orderBy("conv_id", "turn")
    path = new_path(spark, "records")
    files.write_csv(conv, path)
    numbered = files.read_records_indexed(spark, path, conv.schema, na_texts=())
    return files.systematic(numbered, "rec_no", 20)


@query("io_roundtrip_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def io_roundtrip_jsonl(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    path = new_path(spark, "jsonl")
    files.write_json_lines(conv, path)
    return files.read_json_lines(spark, path, conv.schema)


LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("io_roundtrip_text", f"WITH {LINES_SQL} SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS line_no, line AS value FROM l")
def io_roundtrip_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    path = new_path(spark, "text")
    files.write_text_corpus(docs.orderBy("doc_id", "i"), path, "line")
    return files.read_lines_indexed(spark, path).select("line_no", "value")


@query("io_roundtrip_nested", """SELECT doc_id, lang, string_split(text, chr(10))[1] AS first_line, len(string_split(text, chr(10))) AS n_lines,
 CASE WHEN lang = 'en' THEN 'train' ELSE 'test' END AS split FROM documents""")
def io_roundtrip_nested(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang",
        F.struct(F.struct(F.split("text", "\n").alias("content"), F.array("lang").alias("column_header")).alias("table")).alias("input_text"),
    )
    paths = {}
    for split, test in (("train", F.col("lang") == "en"), ("test", F.col("lang") != "en")):
        paths[split] = new_path(spark, "nested") + ".parquet"
        docs.where(test).write.parquet(paths[split])
    content = F.col("input_text")["table"]["content"]
    return files.read_nested_splits(spark, paths, docs.schema).select(
        "doc_id", "lang", F.get(content, F.lit(0)).alias("first_line"), F.size(content).cast("bigint").alias("n_lines"), "split"
    )


@query("io_roundtrip_matrix", "SELECT vec_id, len(embedding) AS dims, embedding[1]::DOUBLE AS first FROM embeddings")
def io_roundtrip_matrix(spark, sf):
    path = new_path(spark, "matrix")
    files.save_matrix(table(spark, sf, "embeddings"), path, "vec_id", "embedding")
    return files.load_matrix(spark, path).select(
        "vec_id", F.size("embedding").cast("bigint").alias("dims"), F.get("embedding", F.lit(0)).alias("first")
    )


# Waves 1 to 5 hold the same four stems: two runs of two stems by name, each in five waves.
SCORED_SQL = f"""{SPLIT_SQL}, {RES}, w AS (SELECT unnest(range(1, 6)) AS w),
chunk AS (SELECT (w - 1) * 2 AS chunk_index, w, [concat('cf', w, 'tax'), concat('cm', w, 'qty')] AS chunk FROM w
  UNION ALL SELECT (w - 1) * 2 + 1, w, [concat('f', w, 'disc'), concat('m', w, 'price')] FROM w),
part AS (SELECT chunk_index, unnest(chunk) AS feature FROM chunk),
bit AS (SELECT id, chunk_index, concat(feature, ' ', CASE WHEN v < med OR (below_smaller AND v = med) THEN 0 ELSE 1 END, ' , ') AS shown
  FROM v JOIN split USING (feature) JOIN part USING (feature) WHERE balanced AND v IS NOT NULL),
line AS (SELECT id, chunk_index, sum(length(shown)) AS n FROM bit GROUP BY id, chunk_index QUALIFY count(*) OVER (PARTITION BY chunk_index) >= {textrows.MIN_CHUNK_ROWS}),
scored AS (SELECT task, chunk_index, prediction + n * CAST(left(task, 1) AS INT) / 10 AS p, truth, avg(ybar_train) OVER (PARTITION BY task, chunk_index) AS ybar
  FROM line JOIN residuals USING (id) WHERE truth IS NOT NULL)
SELECT task, chunk_index, CAST(w AS VARCHAR) AS year, 12345 AS comb, array_to_string(chunk, ',') AS chunk, round({t.r2_sql('p', 'truth', 'ybar')}, 6) AS R
FROM scored JOIN chunk USING (chunk_index) GROUP BY ALL"""


@query("panel_scores", SCORED_SQL)
def panel_scores(spark, sf):
    """The flagship job with the length of the text, times the task's first digit, as the model."""
    res = stage(t.residuals(spark, sf), "residuals")
    cells = t.stored_panel(spark, sf)

    def load(task, chunk):
        weight = int(task[0]) / 10.0
        return lambda batch: batch["text"].str.len() * np.float64(weight)

    def score(texts):
        return models.score_by_model(texts, ["task", "chunk_index"], ["id"], load, keep=["chunk_index", "id", "task"])

    return jobs.panel_scores(
        cells, res, score, chunk_size=2, min_tail=1
    ).select("task", "chunk_index", "year", "comb", F.array_join("chunk", ",").alias("chunk"), r6("R", "R"))
