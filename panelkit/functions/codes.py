"""Rules for coded survey answers and for residual arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import as_column

# The text that marks a missing answer; outcomes by kind; the
# benchmark account of each kind; four-factor scores and training means.
MISSING_TEXT = "Missing"
REGRESSION_TASKS = ("gpa", "grit", "materialHardship")
BINARY_TASKS = ("eviction", "layoff", "jobTraining")
OLS_ACCOUNT = "benchmark_ols_full"
LOGIT_ACCOUNT = "benchmark_logit_full"
FOUR_FACTOR_R2 = {
    "gpa": 0.1059,
    "grit": 0.0146,
    "materialHardship": 0.1773,
    "eviction": 0.0142,
    "layoff": 0.0094,
    "jobTraining": 0.0498,
}
TRAINING_MEANS = {
    "gpa": 2.86673819742489,
    "grit": 3.42753878702398,
    "eviction": 0.0596298834818368,
    "layoff": 0.209083790133125,
    "materialHardship": 0.103744781606331,
    "jobTraining": 0.234770704996578,
}


def sentinel_to_null(value: Column | str) -> Column:
    """Negative codes and NaN become null."""
    v = as_column(value)
    return F.when(~F.isnan(v) & (v >= 0), v)


def is_valid(value: Column | str | None = None, text: Column | str | None = None) -> Column:
    """Number >= 0, or text that is not the missing mark; never null."""
    ok = F.lit(False)
    if value is not None:
        ok = ok | F.coalesce(sentinel_to_null(value).isNotNull(), F.lit(False))
    if text is not None:
        ok = ok | F.coalesce(as_column(text) != MISSING_TEXT, F.lit(False))
    return ok


def binarize(value: Column, median: Column, below_smaller: Column) -> Column:
    """0/1 split at the median; the median itself joins the smaller side."""
    low = (value < median) | (below_smaller & (value == median))
    return F.when(value.isNotNull(), F.when(low, F.lit(0)).otherwise(F.lit(1)))


def indicators(value: Column | str, names: Mapping[str, object], others: str) -> list[Column]:
    """One 0/1 column per listed code plus one for every other code."""
    v = as_column(value)
    cols = [(v == F.lit(code)).cast("double").alias(name) for name, code in names.items()]
    return [*cols, (~v.isin(*names.values())).cast("double").alias(others)]


def row_mean(cols: Sequence[Column | str]) -> Column:
    """Mean of several complete columns of the same row."""
    total = as_column(cols[0])
    for c in cols[1:]:
        total = total + as_column(c)
    return total / F.lit(len(cols))


def residual(truth: Column | str, prediction: Column | str) -> Column:
    return as_column(truth) - as_column(prediction)


def corrected(prediction: Column | str, predicted_diff: Column | str) -> Column:
    return as_column(prediction) + as_column(predicted_diff)


def benchmark_account(task: Column | str, ols_tasks: Sequence[str] = REGRESSION_TASKS) -> Column:
    return F.when(as_column(task).isin(*ols_tasks), F.lit(OLS_ACCOUNT)).otherwise(F.lit(LOGIT_ACCOUNT))


def cast_label(
    task: Column | str, label: Column | str, binary_tasks: Sequence[str] = BINARY_TASKS
) -> Column:
    """Binary outcomes lose their fraction, the others stay double."""
    y = as_column(label).cast("double")
    return F.when(as_column(task).isin(*binary_tasks), y.cast("int").cast("double")).otherwise(y)


def within_open(value: Column | str, low: float, high: float) -> Column:
    """low < value < high: the rule that drops outliers."""
    v = as_column(value)
    return (v > low) & (v < high)
