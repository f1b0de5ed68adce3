"""Labels and predictions joined to the rows of their ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..sources.staging import stage
from .joins import fan_out, lookup_join


def fan_out_labels(labels: DataFrame, rows: DataFrame, key: str, task: str, label: str) -> DataFrame:
    """Repeat each known label for all rows of its id; ids without rows vanish."""
    known = labels.where(F.col(label).isNotNull()).select(
        key, task, codes.cast_label(task, label).alias(label)
    )
    return fan_out(rows, known, [key], "labels")


def attach_by_id(rows: DataFrame, one_per_id: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys, where a positional attach would depend on row order."""
    return lookup_join(rows, one_per_id, keys)


def chunk_prediction_table(chunk_preds: DataFrame, residuals: DataFrame) -> DataFrame:
    """Chunk predictions with the residual of their (id, task)."""
    return lookup_join(chunk_preds, residuals.select("id", "task", "diff"), ["id", "task"])


def chunk_regression_cells(cells: DataFrame, chunks: DataFrame, residuals: DataFrame) -> DataFrame:
    """Regression cells of all chunks at once: (chunk_index, id, feature, value, task, diff).

    A feature of several chunks is repeated for each, a cell for each task of
    its id; only ids with a residual stay.
    """
    listed = chunks.select("chunk_index", F.explode("chunk").alias("feature"))
    spread = fan_out(cells.select("id", "feature", "value"), listed, ["feature"], "chunk_of")
    return fan_out(spread, residuals.select("id", "task", "diff"), ["id"], "tasks_of")


def uncovered_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Ids that have no row."""
    have = stage(rows.select(key).distinct(), "covered")
    return lookup_join(ids.select(key).distinct(), have, [key], "left_anti")


def assert_covered(ids: DataFrame, rows: DataFrame, key: str) -> None:
    absent = uncovered_ids(ids, rows, key).count()
    if absent:
        raise ValueError(f"{absent} ids have no rows")


def rows_of_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of the listed ids."""
    return lookup_join(rows, stage(ids.select(key).distinct(), "wanted"), [key], "left_semi")


def side_by_side(left: DataFrame, right: DataFrame, key: str, suffix: str = "_imp") -> DataFrame:
    """Two versions of a table next to each other, joined on the row key."""
    renamed = right.select(key, *[F.col(c).alias(c + suffix) for c in right.columns if c != key])
    return left.join(renamed, key)
