"""Model-based imputation: chained equations and predictive mean matching.

All completed copies of a table are stacked in one DataFrame. A fit is one
aggregation for all copies: tasks add up products of the columns, Spark sums
them by copy, and the driver solves systems as wide as the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws
from ..sources.staging import stage
from .ordering import in_pieces

# Newton steps of a classifier at most, the change that ends them, and the
# penalty for each row on scaled weights, which keeps separable classes finite.
NEWTON_STEPS = 25
NEWTON_END = 1e-6
PENALTY = 1e-4


def _normal(seed: object, *keys: Column | str) -> Column:
    """Standard normal draw from two uniform ones."""
    size = F.lit(float(2**48))
    u = (draws.draw_int(seed, *keys, F.lit("u")) + 1) / (size + 1)
    v = draws.draw_int(seed, *keys, F.lit("v")) / size
    return F.sqrt(-2 * F.log(u)) * F.cos(v * F.lit(6.283185307179586))


def _sums(
    df: DataFrame, by: str | None, columns: Sequence[str],
    terms: Callable[[int, np.ndarray], np.ndarray],
) -> dict[int, np.ndarray]:
    """``terms(group, rows)`` summed over all rows of each group.

    Every task adds up its own rows first. The result has one vector for each
    stacked table, as long as ``terms`` makes it, whatever the number of rows.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch["_g"].to_numpy()
            rows = batch.drop(columns="_g").to_numpy(dtype="float64")
            for g in np.unique(groups):
                part = terms(int(g), rows[groups == g])
                total[int(g)] = total[int(g)] + part if int(g) in total else part
        for g, vector in total.items():
            yield pd.DataFrame({"g": g, "i": np.arange(len(vector)), "v": vector})

    group = F.col(by).cast("int") if by else F.lit(1)
    rows = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    found = rows.mapInPandas(run, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v"))
    out: dict[int, dict[int, float]] = {}
    for r in found.toLocalIterator():
        out.setdefault(r.g, {})[r.i] = r.v
    return {g: np.array([v for _, v in sorted(vector.items())]) for g, vector in out.items()}


def _centres(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column (1 where it is constant): one row."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(columns))])
    spread = np.array([row[f"s{i}"] or 1.0 for i in range(len(columns))])
    return mean, spread


def _least_squares(
    known: DataFrame, by: str | None, target: str, others: Sequence[str]
) -> dict[int, tuple[list[float], float]]:
    """For each stacked table: intercept and weights, and the root mean squared residual.

    Columns are centred and scaled before their products are summed; a column
    that others explain gets the shortest of the equal solutions.
    """
    mean, spread = _centres(known, [*others, target])

    def products(_: int, rows: np.ndarray) -> np.ndarray:
        z = np.hstack([np.ones((len(rows), 1)), (rows - mean) / spread])
        return (z.T @ z).ravel()

    fits = {}
    for g, flat in _sums(known, by, [*others, target], products).items():
        gram = flat.reshape(len(others) + 2, -1)
        if not np.isfinite(gram).all():
            raise ValueError(f"null or non-finite values among {[*others, target]}")
        w = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=1e-12)[0]
        left = gram[-1, -1] - 2 * w @ gram[:-1, -1] + w @ gram[:-1, :-1] @ w
        slopes = w[1:] / spread[:-1] * spread[-1]
        start = mean[-1] + w[0] * spread[-1] - slopes @ mean[:-1]
        rmse = np.sqrt(max(left, 0.0) / gram[0, 0]) * spread[-1]
        fits[g] = ([float(start), *map(float, slopes)], float(rmse))
    if not fits:
        raise ValueError(f"{target} has no known value")
    return fits


def _of_group(values: Mapping[int, object], by: str | None) -> Column:
    """The entry of the row's stacked table, null for a table without one."""
    if not by:
        return F.lit(values[1])
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col(by).cast("int")]


def _dot(weights: Column, others: Sequence[str]) -> Column:
    """Intercept plus weighted columns, inside the row."""
    terms = F.zip_with(weights, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in others]), lambda w, x: w * x)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _linear(fits: Mapping[int, tuple[list[float], float]], by: str | None, others: Sequence[str]) -> Column:
    return _dot(_of_group({g: w for g, (w, _) in fits.items()}, by), others)


def _classifier(
    known: DataFrame, by: str, target: str, others: Sequence[str], n_classes: int,
    start: Mapping[int, np.ndarray] | None = None,
) -> tuple[dict[int, list[list[float]]], dict[int, np.ndarray]]:
    """For each stacked table: weights of classes 1, 2, ... against class 0, and the scaled ones.

    Penalised Newton steps; one aggregation a step for all tables at once. A
    step that lowers the likelihood is halved. ``start`` are earlier scaled weights.
    """
    mean, spread = _centres(known, others)
    width, free = len(others) + 1, n_classes - 1
    now = {g: w.copy() for g, w in (start or {}).items()}
    best: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(NEWTON_STEPS):
        weights = dict(now)

        def terms(g: int, rows: np.ndarray) -> np.ndarray:
            z = np.hstack([np.ones((len(rows), 1)), (rows[:, :-1] - mean) / spread])
            w = weights.get(g, np.zeros((free, width)))
            scores = np.hstack([np.zeros((len(z), 1)), z @ w.T])
            scores -= scores.max(axis=1, keepdims=True)
            log_p = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
            p = np.exp(log_p)[:, 1:]
            code = rows[:, -1].astype("int64")
            hit = (code[:, None] == np.arange(1, n_classes)).astype("float64")
            slope = (hit - p).T @ z
            bend = np.block([[(z * (p[:, [k]] * ((k == j) - p[:, [j]]))).T @ z for j in range(free)] for k in range(free)])
            likelihood = log_p[np.arange(len(z)), code].sum()
            return np.concatenate([[len(z), likelihood], slope.ravel(), bend.ravel()])

        largest = 0.0
        for g, flat in _sums(known, by, [*others, target], terms).items():
            n, likelihood = flat[:2]
            w = weights.get(g, np.zeros((free, width)))
            value = likelihood - PENALTY * n / 2 * (w**2).sum()
            if not np.isfinite(value):
                raise ValueError(f"null or non-finite values among {[*others, target]}")
            if g in best and value < best[g][0]:
                step = (best[g][1] - w) / 2
            else:
                best[g] = (value, w)
                slope = flat[2 : 2 + w.size] - PENALTY * n * w.ravel()
                bend = flat[2 + w.size :].reshape(w.size, w.size) + PENALTY * n * np.eye(w.size)
                step = np.linalg.solve(bend, slope).reshape(w.shape)
            now[g] = w + step
            largest = max(largest, float(np.abs(step).max(initial=0.0)))
        if largest < NEWTON_END:
            break
    if not best:
        raise ValueError(f"{target} has no known value")
    plain = {}
    for g, (_, w) in best.items():
        slopes = w[:, 1:] / spread
        plain[g] = np.column_stack([w[:, 0] - slopes @ mean, slopes]).tolist()
    return plain, {g: w for g, (_, w) in best.items()}


def impute_chained(
    df: DataFrame, key: str, strategies: Mapping[str, str], predictors: Sequence[str] = (),
    copies: int = 5, rounds: int = 3, seed: object = 0,
) -> DataFrame:
    """Chained-equation imputation: ``copies`` completed tables, stacked by ``copy_no``.

    ``strategies`` names each column with gaps: 'least squares' (numeric,
    prediction plus a normal residual), 'pmm' (numeric, nearest donor) or
    'multinomial logistic' (codes 0, 1, 2, ..., a draw from the predicted
    classes). Every round refits each column on all others, for all copies in
    the same aggregations, and is stored. A null predictor and a column
    without any value are errors.
    """
    if copies < 1:
        raise ValueError("copies must be at least 1")
    targets = list(strategies)
    for how in strategies.values():
        if how not in ("least squares", "pmm", "multinomial logistic"):
            raise ValueError(f"unknown strategy {how!r}")
    known = [
        F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is null")).cast(df.schema[c].dataType)).alias(c)
        for c in predictors
    ]
    base = stage(
        df.select(key, *known, *targets, *[F.col(c).isNull().alias(f"_gap_{c}") for c in targets]),
        "chained",
    )
    # First fill: mean, or the most frequent code.
    start, classes = {}, {}
    for c, how in strategies.items():
        if how == "multinomial logistic":
            top = base.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
            start[c] = top[0] if top else None
            classes[c] = int(base.agg(F.max(c)).first()[0] or 0) + 1
        else:
            start[c] = base.agg(F.avg(c)).first()[0]
        if start[c] is None:
            raise ValueError(f"{c} has no known value")
    first = [F.coalesce(F.col(c).cast("double"), F.lit(float(start[c]))).alias(c) for c in targets]
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy_no")
    filled = base.select(copy, key, *predictors, *first, *[f"_gap_{c}" for c in targets])
    scaled: dict[str, dict[int, np.ndarray]] = {}
    for number in range(1, rounds + 1):
        for c, how in strategies.items():
            others = [*predictors, *[t for t in targets if t != c]]
            gap = F.col(f"_gap_{c}")
            draw = [F.col("copy_no"), F.lit(number), F.lit(c), F.col(key)]
            if how == "pmm":
                filled = stage(impute_pmm(filled, key, c, others, f"_gap_{c}", "copy_no"), "matched")
            elif how == "least squares":
                fits = _least_squares(filled.where(~gap), "copy_no", c, others)
                spread = _of_group({g: rmse for g, (_, rmse) in fits.items()}, "copy_no")
                value = _linear(fits, "copy_no", others) + spread * _normal(seed, *draw)
                filled = filled.withColumn(c, F.when(gap, value).otherwise(F.col(c)))
            elif classes[c] > 1:
                plain, scaled[c] = _classifier(filled.where(~gap), "copy_no", c, others, classes[c], scaled.get(c))
                filled = filled.withColumn(c, F.when(gap, _drawn_class(plain, others, classes[c], seed, draw)).otherwise(F.col(c)))
        filled = stage(filled, "chained")
    return filled.select("copy_no", key, *predictors, *targets)


def _drawn_class(
    weights: Mapping[int, list[list[float]]], others: Sequence[str], n_classes: int, seed: object,
    keys: Sequence[Column],
) -> Column:
    """The first class whose running probability exceeds the row's draw."""
    scores = F.transform(_of_group(weights, "copy_no"), lambda w: _dot(w, others))
    scores = F.concat(F.array(F.lit(0.0)), scores)
    powers = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    share = draws.draw_int(seed, *keys) / F.lit(float(2**48))
    bound = share * F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    state = F.aggregate(
        powers,
        F.struct(F.lit(0.0).alias("p"), F.lit(0).alias("n")),
        lambda s, p: F.struct(
            (s["p"] + p).alias("p"), (s["n"] + (s["p"] + p <= bound).cast("int")).alias("n")
        ),
    )
    return F.least(state["n"], F.lit(n_classes - 1)).cast("double")


def impute_pmm(
    df: DataFrame, key: str, target: str, predictors: Sequence[str], gap: str | None = None,
    by: str | None = None,
) -> DataFrame:
    """Predictive mean matching: the row with the nearest prediction gives its value.

    Rows are range-partitioned by prediction; inside a piece the donors before
    and after a row come from windows, across pieces from one row per piece.
    The lower donor wins ties. ``by`` holds small positive numbers of tables
    that are stacked in ``df``: each is fitted and matched by itself.
    """
    group = [by] if by else []
    open_ = F.col(gap) if gap else F.col(target).isNull()
    marked = df.withColumn("_open", open_)
    fits = _least_squares(marked.where(~F.col("_open")), by, target, predictors)
    predicted = marked.withColumn("_pred", _linear(fits, by, predictors))
    pieces = in_pieces(predicted, [*group, "_pred", key])
    donor = F.when(
        ~F.col("_open"), F.struct(F.col("_pred").alias("at"), F.col(target).cast("double").alias("v"))
    )
    order = F.struct("_pred", key)
    edges = pieces.where(~F.col("_open")).groupBy("_piece", *group).agg(
        F.max_by(donor, order).alias("_last"), F.min_by(donor, order).alias("_first")
    )
    # One row per piece (and stacked table).
    all_pieces = pieces.select("_piece", *group).distinct().join(edges, ["_piece", *group], "left")
    by_piece = Window.partitionBy(*group).orderBy("_piece")
    carried = all_pieces.select(
        "_piece",
        *group,
        F.last("_last", ignorenulls=True)
        .over(by_piece.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True)
        .over(by_piece.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    inside = Window.partitionBy("_piece", *group).orderBy("_pred", key)
    near = (
        pieces.join(F.broadcast(carried), ["_piece", *group])
        .withColumn(
            "_below",
            F.coalesce(
                F.last(donor, ignorenulls=True)
                .over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
                F.col("_earlier"),
            ),
        )
        .withColumn(
            "_above",
            F.coalesce(
                F.first(donor, ignorenulls=True)
                .over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
                F.col("_later"),
            ),
        )
    )
    below, above = F.col("_below"), F.col("_above")
    lower = above.isNull() | (
        below.isNotNull() & (F.col("_pred") - below["at"] <= above["at"] - F.col("_pred"))
    )
    value = F.when(F.col("_open"), F.when(lower, below["v"]).otherwise(above["v"])).otherwise(
        F.col(target).cast("double")
    )
    return near.withColumn(target, value).select(*df.columns)
