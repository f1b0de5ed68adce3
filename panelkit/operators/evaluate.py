"""Scores of predictions: holdout R2, errors, ensembles and grids.

Each score is one aggregation that is combined before the shuffle, so a task
with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.arrays import argmax
from ..functions.draws import as_column
from ..sources.staging import stage
from .joins import lookup_join
from .quantiles import exact_quantiles, quantile_at, rank_steps


def holdout_r2(prediction: Column | str, truth: Column | str, mean: Column | str) -> Column:
    """Aggregate: 1 - sum (p - g)^2 / sum (m - g)^2 over rows with a truth.

    ``mean`` is the column of training means (or a literal), averaged over the
    kept rows. The lower sum is n * var(g) + n * (avg(g) - m)^2, which needs no
    second pass. A kept row without a prediction makes the score null.
    """
    g = as_column(truth)
    p = as_column(prediction)
    known = g.isNotNull()
    m = F.avg(F.when(known, as_column(mean)))
    n = F.count(g)
    upper = F.sum(F.when(known, (p - g) * (p - g)))
    lower = n * F.var_pop(g) + n * (F.avg(g) - m) * (F.avg(g) - m)
    complete = F.count(F.when(known, p)) == n
    return F.when(complete & (lower > 0), 1 - upper / lower)


def r2_by(
    df: DataFrame, keys: Sequence[str], prediction: str = "prediction", truth: str = "truth",
    mean: str = "ybar_train",
) -> DataFrame:
    return df.groupBy(*keys).agg(holdout_r2(prediction, truth, mean).alias("R"))


def r2_from_train(
    test: DataFrame, train: DataFrame, keys: Sequence[str], prediction: str, truth: str, train_y: str
) -> DataFrame:
    """R2 whose denominator uses the mean of the training outcomes."""
    means = train.groupBy(*keys).agg(F.avg(train_y).alias("_m"))
    if not keys:
        one = means.scalar()
        return test.withColumn("_m", one).agg(holdout_r2(prediction, truth, "_m").alias("R"))
    joined = lookup_join(test, stage(means, "train_means"), keys)
    return r2_by(joined, keys, prediction, truth, "_m")


def mae(prediction: Column | str, truth: Column | str) -> Column:
    return F.avg(F.abs(as_column(prediction) - as_column(truth)))


def accuracy(logits: Column | str, label: Column | str) -> Column:
    """Share of rows whose largest logit is the label's."""
    return F.avg((argmax(as_column(logits)) == as_column(label)).cast("double"))


def corr_pred_gold(df: DataFrame, keys: Sequence[str], prediction: str, truth: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.corr(prediction, truth).alias("corr"))


def with_residual(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Rows with a known truth and ``diff`` = truth - prediction."""
    return df.where(F.col(truth).isNotNull()).withColumn("diff", codes.residual(truth, prediction))


def select_benchmark(
    df: DataFrame, task: str = "outcome", account: str = "account",
    ols_tasks: Sequence[str] = codes.REGRESSION_TASKS,
) -> DataFrame:
    """Rows of the benchmark account that fits the outcome's kind."""
    return df.where(F.col(account) == codes.benchmark_account(task, ols_tasks))


def five_number(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Min, median, max, mean and population deviation."""
    clean = F.col(value)
    basic = df.groupBy(*keys).agg(
        F.min(clean).alias("min"),
        F.max(clean).alias("max"),
        F.avg(clean).alias("mean"),
        F.stddev_pop(clean).alias("std_pop"),
    )
    medians = exact_quantiles(df, keys, value, {"median": 0.5}).drop("n")
    if not keys:
        return basic.withColumn("median", medians.scalar())
    return basic.join(medians, list(keys), "left")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per column."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]
    cells = df.select(F.inline(F.array(*pairs)))
    basic = cells.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std_samp"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return basic.join(exact_quantiles(cells, ["column"], "v", shares).drop("n"), "column", "left")


def mean_per_id(df: DataFrame, keys: Sequence[str], value: str, out: str = "predicted_diff") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def mean_and_median_per_id(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Both ensembles of an id's scores: ``mean_diff`` and ``median_diff``."""
    steps = rank_steps(df, keys, value, [0.5])
    medians = steps.groupBy(*keys).agg(quantile_at(0.5).alias("median_diff"))
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean_diff"), F.count(value).alias("n_rows"))
    return means.join(medians, list(keys))


def best_pick(df: DataFrame, keys: Sequence[str], prediction: str, target: str, order: str) -> DataFrame:
    """Per id the prediction nearest to the target, the first on ties."""
    rank = F.struct(F.abs(F.col(prediction) - F.col(target)), F.col(order))
    return df.groupBy(*keys).agg(F.min_by(prediction, rank).alias("best"))


def apply_correction(df: DataFrame, prediction: str = "prediction", diff: str = "predicted_diff") -> DataFrame:
    return df.withColumn("new_prediction", codes.corrected(prediction, diff))


def evaluate_grid(
    scores: DataFrame, residuals: DataFrame, unit: Sequence[str] = ("chunk_index",)
) -> DataFrame:
    """R2 of the corrected prediction for every (task, unit) in one job.

    ``scores`` has rows (id, task, unit..., score), any number per id; their
    mean corrects the prediction in ``residuals`` (id, task, prediction, truth,
    ybar_train).
    """
    means = mean_per_id(scores, ["id", "task", *unit], "score")
    joined = apply_correction(lookup_join(stage(means, "means"), residuals, ["id", "task"], spread=True))
    return r2_by(joined, ["task", *unit], "new_prediction")


def compare_with_baseline(
    df: DataFrame, keys: Sequence[str], corrections: dict[str, str], prediction: str = "prediction",
    truth: str = "truth", mean: str = "ybar_train",
) -> DataFrame:
    """R2 with each correction, without any, and the gains.

    ``corrections`` maps a score name to the column that is added.
    """
    base = holdout_r2(prediction, truth, mean)
    scored = df.groupBy(*keys).agg(
        base.alias("R_base"),
        *[
            holdout_r2(codes.corrected(prediction, c), truth, mean).alias(f"R_{name}")
            for name, c in corrections.items()
        ],
    )
    return scored.withColumns({f"gain_{n}": F.col(f"R_{n}") - F.col("R_base") for n in corrections})


def k_sweep(
    rows: DataFrame, residuals: DataFrame, ks: Sequence[int], row: Sequence[str], seed: object,
    strict: bool = True,
) -> DataFrame:
    """R2 by sample size: (k, task, R).

    ``rows`` is (id, row..., score); every id is ranked once for all k.
    """
    from .sampling import k_means_per_id

    means = k_means_per_id(rows, "id", row, "score", ks, seed, strict)
    joined = apply_correction(means.join(residuals, "id"))
    return r2_by(joined, ["k", "task"], "new_prediction")
