"""Trees and boosting on the test tables; their SQL twins grow the same trees level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_below, share_limit
from ..operators import evaluate, labels, models, report, trees
from ..operators.joins import lookup_join
from ..plans import jobs
from ..sources.staging import stage
from . import tables as t
from .registry import query, r6

SIZE = 7
CHUNKS = {i // SIZE: t.PANEL_FEATURES[i : i + SIZE] for i in range(0, len(t.PANEL_FEATURES), SIZE)}
#: Rounds whose losses are compared.
FIRST_ROUNDS = 3


def _below(seed: int, key: str, share: float) -> str:
    return f"substr(md5(concat_ws(':', '{seed}', {key})), 1, 8) < '{share_limit(share)}'"


def _binned_sql(name: str, values: str, keys: str) -> str:
    """CTEs ``{name}_edges``: the distinct values of ``values(keys, place, value)`` at the ranks k / MAX_BINS."""
    return f"""{name}_ranked AS (SELECT {keys}place, value, row_number() OVER (PARTITION BY {keys}place ORDER BY value) AS rn, count(*) OVER (PARTITION BY {keys}place) AS n
  FROM {values} WHERE value IS NOT NULL),
{name}_edges AS MATERIALIZED (SELECT {keys}place, list_sort(list(DISTINCT value)) AS edges FROM {name}_ranked
  WHERE list_contains(list_transform(range(1, {trees.MAX_BINS}), lambda k: ceil(k * n / {trees.MAX_BINS}.0)::BIGINT), rn) GROUP BY ALL)"""


def _level_sql(out: str, rows: str, keys: str, where: str, last: bool = False) -> str:
    """CTE ``{out}``: the best split of every node of ``rows``, as ``trees.best_splits``."""
    part = lambda s, w: f"({s})::DOUBLE * ({s})::DOUBLE / ({w})::DOUBLE"
    gain = f"{part('sl', 'wl')} + {part('s - sl', 'w - wl')}"
    best = "NULL" if last else f"CASE WHEN min(low) < max(high) THEN max({{'g': {gain}, 'f': -f, 'b': -bin, 'sl': sl, 'wl': wl}}) FILTER (nl < n AND wl > 0 AND w > wl) END"
    fields = "NULL::INTEGER AS feature, NULL::INTEGER AS bin, NULL::DOUBLE AS lv, NULL::DOUBLE AS rv" if last else """(-best.f)::INTEGER AS feature, (-best.b)::INTEGER AS bin,
    best.sl::DOUBLE / best.wl::DOUBLE AS lv, (s - best.sl)::DOUBLE / (w - best.wl)::DOUBLE AS rv"""
    return f"""{out} AS MATERIALIZED (
  WITH c AS (SELECT {keys}, node, f, bin, count(*) AS n, sum(w)::HUGEINT AS w, sum(w::HUGEINT * y) AS s, min(y) AS low, max(y) AS high
             FROM (SELECT {keys}, node, w, y, unnest(bins) AS bin, unnest(range(len(bins))) AS f FROM {rows} {where}) GROUP BY ALL),
  k AS (SELECT {keys}, node, f, bin, low, high, sum(n) OVER u AS nl, sum(w) OVER u AS wl, sum(s) OVER u AS sl, sum(n) OVER o AS n, sum(w) OVER o AS w, sum(s) OVER o AS s
        FROM c WINDOW o AS (PARTITION BY {keys}, node, f), u AS (PARTITION BY {keys}, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT {keys}, node, max(n)::BIGINT AS n, max(w) AS w, max(s) AS s, {best} AS best FROM k GROUP BY {keys}, node)
  SELECT {keys}, node, n, s::DOUBLE / w::DOUBLE AS value, {fields} FROM g)"""


def _trees_sql(depth: int) -> str:
    values = ", ".join(f"({c}, '{f}', {i})" for c, fs in CHUNKS.items() for i, f in enumerate(fs))
    parts = [f"""{t.PANEL_SQL}, {t.RESIDUAL_SQL}, {t.TWO_TASKS_SQL},
places(chunk_index, feature, place) AS (VALUES {values}),
wide AS MATERIALIZED (SELECT chunk_index, id, place, value FROM panel JOIN places USING (feature)
  WHERE id IN (SELECT id FROM two_tasks WHERE diff IS NOT NULL)),
{_binned_sql("wide", "wide", "chunk_index, ")},
means AS (SELECT chunk_index, place, round(avg(value), {trees.MEAN_PLACES}) AS mean FROM wide WHERE value IS NOT NULL GROUP BY ALL),
full_chunks AS (SELECT chunk_index FROM means GROUP BY ALL HAVING count(*) = {SIZE}),
binned AS MATERIALIZED (SELECT i.chunk_index, i.id, list(len(list_filter(e.edges, lambda x: x < coalesce(w.value, m.mean))) ORDER BY p.place) AS bins
  FROM (SELECT DISTINCT chunk_index, id FROM wide JOIN full_chunks USING (chunk_index)) i JOIN places p USING (chunk_index)
  JOIN wide_edges e USING (chunk_index, place) JOIN means m USING (chunk_index, place) LEFT JOIN wide w USING (chunk_index, id, place) GROUP BY ALL),
r0 AS MATERIALIZED (SELECT chunk_index, task, id, diff, bins, NOT {_below(1, "id", 0.2)} AS train, round(diff * {trees.SCALE})::BIGINT AS y, 1 AS w, 1::BIGINT AS node
  FROM binned JOIN two_tasks USING (id) WHERE diff IS NOT NULL)"""]
    for level in range(depth + 1):
        parts.append(_level_sql(f"s{level}", f"r{level}", "chunk_index, task", "WHERE train", level == depth))
        parts.append(f"e{level} AS (SELECT r.*, value FROM r{level} r JOIN s{level} USING (chunk_index, task, node) WHERE feature IS NULL)")
        if level < depth:
            parts.append(f"""r{level + 1} AS MATERIALIZED (SELECT r.* REPLACE (2 * node + (bins[feature + 1] > s.bin)::INTEGER AS node)
  FROM r{level} r JOIN s{level} s USING (chunk_index, task, node) WHERE feature IS NOT NULL)""")
    return "WITH " + ",\n".join(parts)


_LEVELS = range(models.TREE_DEPTH + 1)
_TREES = _trees_sql(models.TREE_DEPTH)


def _cells(spark, sf):
    cells = t.panel(spark, sf).select("id", "feature", "value")
    chunks = spark.createDataFrame(list(CHUNKS.items()), "chunk_index long, chunk array<string>")
    known = t.two_tasks(spark, sf).where("diff IS NOT NULL")
    return stage(labels.chunk_regression_cells(cells, chunks, stage(known, "known")), "tree_cells")


@query("tree_per_chunk", f"""{_TREES}
SELECT chunk_index::BIGINT AS chunk_index, task, count(*) AS n_test, round(avg(abs(diff - value / {trees.SCALE})), 6) AS mae
FROM ({" UNION ALL ".join(f"SELECT * FROM e{i}" for i in _LEVELS)}) WHERE NOT train GROUP BY ALL""")
def tree_per_chunk(spark, sf):
    return models.tree_per_chunk(_cells(spark, sf), CHUNKS, ~draw_below(1, 0.2, "id")).withColumn("mae", F.round("mae", 6))


@query("tree_splits", f"""{_TREES}
SELECT n.chunk_index::BIGINT AS chunk_index, task, node, n, value / {trees.SCALE} AS value, p.feature, edges[bin + 1] AS threshold
FROM ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in _LEVELS)}) n
LEFT JOIN places p ON p.chunk_index = n.chunk_index AND p.place = n.feature LEFT JOIN wide_edges e ON e.chunk_index = n.chunk_index AND e.place = n.feature""")
def tree_splits(spark, sf):
    nodes, _ = models.tree_splits(_cells(spark, sf), CHUNKS, ~draw_below(1, 0.2, "id"))
    return nodes  # values are quotients of the same whole numbers on both sides


FEATURES = [f"c{i}" for i in range(t.N_SCORE_CHUNKS)]


def _boost_rows(spark, sf):
    """Chunk predictions of each (id, task) with its residual; a chunk without a prediction counts as its mean."""
    res = stage(evaluate.with_residual(t.residuals(spark, sf)), "residuals")
    means = evaluate.mean_per_id(t.task_scores(spark, sf, res), ["id", "task", "chunk_index"], "score")
    wide = report.pivot_chunk_predictions(means, range(t.N_SCORE_CHUNKS)).toDF("id", "task", *FEATURES)
    wide = stage(wide, "wide")
    # Predictions may be negative, so the fill for coded answers does not fit.
    filled = wide.fillna(wide.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict())
    filled = filled.select("id", "task", *[F.round(c, 3).alias(c) for c in FEATURES])
    return res, stage(labels.chunk_prediction_table(filled, res), "boost_rows")


@query("boost_chunk_predictions")
def boost_chunk_predictions(spark, sf):
    """Boosted correction of the benchmark from the chunk predictions, by task, in all rounds."""
    res, rows = _boost_rows(spark, sf)
    in_test = draw_below(2, 0.2, "id")
    return jobs.corrected_by_boosting(rows.where(~in_test), rows.where(in_test).drop("diff"), res, FEATURES)


def _boost_sql(rounds: int) -> str:
    places = ", ".join(f"({i})" for i in range(t.N_SCORE_CHUNKS))
    depth, rate = models.BOOST_DEPTH, models.BOOST_RATE
    parts = [f"""{t.RESIDUAL_SQL}, {t.SCORES_SQL}, known AS (SELECT * FROM residuals WHERE truth IS NOT NULL),
per_id AS (SELECT s.id, r.task, s.chunk_index AS place, avg(score) AS value FROM scores s JOIN known r USING (id) GROUP BY ALL),
places(place) AS (VALUES {places}), own_means AS (SELECT place, avg(value) AS mean FROM per_id GROUP BY ALL),
filled AS MATERIALIZED (SELECT i.id, i.task, p.place, round(coalesce(v.value, m.mean), 3) AS value FROM (SELECT DISTINCT id, task FROM per_id) i CROSS JOIN places p
  JOIN own_means m USING (place) LEFT JOIN per_id v USING (id, task, place)),
training AS MATERIALIZED (SELECT f.*, r.diff FROM filled f JOIN known r USING (id, task) WHERE NOT {_below(2, "id", 0.2)}),
{_binned_sql("training", "training", "")},
w1 AS MATERIALIZED (SELECT id, task, round(any_value(diff) * {trees.SCALE})::BIGINT AS y, list(len(list_filter(edges, lambda x: x < value)) ORDER BY place) AS bins, 1.0::DOUBLE AS weight
  FROM training JOIN training_edges USING (place) GROUP BY id, task)"""]
    for r in range(1, rounds + 1):
        parts.append(f"b{r}_0 AS MATERIALIZED (SELECT *, greatest(round(weight * {trees.WEIGHT_SCALE})::BIGINT, 1) AS w, 1::BIGINT AS node, NULL::DOUBLE AS value FROM w{r})")
        for level in range(depth):
            parts.append(_level_sql(f"q{r}_{level}", f"b{r}_{level}", "task", "WHERE value IS NULL"))
            right = "(bins[feature + 1] > s.bin)"
            reached = f"CASE WHEN r.value IS NOT NULL THEN r.value WHEN feature IS NULL THEN s.value {f'WHEN {right} THEN rv ELSE lv' if level == depth - 1 else ''} END"
            parts.append(f"""b{r}_{level + 1} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN feature IS NULL THEN node ELSE 2 * node + {right}::INTEGER END AS node, {reached} AS value)
  FROM b{r}_{level} r LEFT JOIN q{r}_{level} s USING (task, node))""")
        parts.append(f"""l{r} AS MATERIALIZED (SELECT task, max(abs(y - value)) AS worst, sum(weight) AS total, sum(weight * abs(y - value)) / max(abs(y - value)) / sum(weight) AS loss, count(*) AS n
  FROM b{r}_{depth} GROUP BY task)""")
        parts.append(f"""w{r + 1} AS MATERIALIZED (SELECT id, task, y, bins, weight * n / total * pow(loss / (1 - loss), (1 - abs(y - value) / worst) * {rate}) AS weight
  FROM b{r}_{depth} JOIN l{r} USING (task) WHERE loss < 0.5)""")
    out = " UNION ALL ".join(f"SELECT {r} AS round, task, {rate} * ln((1 - loss) / loss) AS weight FROM l{r} WHERE loss < 0.5" for r in range(1, rounds + 1))
    return "WITH " + ",\n".join(parts) + f"\nSELECT round, task, round(weight, 9) AS weight FROM ({out})"


@query("boost_rounds", _boost_sql(FIRST_ROUNDS))
def boost_rounds(spark, sf):
    """Weights of the trees of the first rounds, which follow from their losses."""
    _, rows = _boost_rows(spark, sf)
    own = rows.where(~draw_below(2, 0.2, "id"))
    model, _ = models.boosted_correction(own, own.limit(0), FEATURES, FIRST_ROUNDS)
    found = [(r, task, w) for r, weights in enumerate(model.weights, 1) for (task,), w in weights.items()]
    return spark.createDataFrame(found, "round int, task string, weight double").select("round", "task", r6("weight", "weight", 9))
