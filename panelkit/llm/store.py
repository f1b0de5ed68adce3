"""Stored steps: written below ``spark.checkpoint.dir``, with their shuffle files freed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import staging

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives any executor, so the shuffle files behind it
    are of no more use; they are dropped when the write ends.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        return staging.stage(df, name)
    finally:
        if before is None:
            conf.unset(_FREE)
        else:
            conf.set(_FREE, before)
