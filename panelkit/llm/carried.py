"""Columns computed from the text by an Arrow task that carries the whole row through: no key, no join, no stored copy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import grams

#: Arrays of the new columns for the rows of a piece.
Compute = Callable[[pa.RecordBatch, grams.Piece], list[pa.Array]]


def with_columns(df: DataFrame, text: str, added: list[tuple[str, T.DataType]], begin: Callable[[], Compute], piece_bytes: int = grams.PIECE_BYTES) -> DataFrame:
    """``df`` and the ``added`` columns; ``begin`` makes a task's function, called for every piece of its batches."""
    df = df.withColumn(text, df[text].cast("string"))
    at, names = df.columns.index(text), [*df.columns, *(n for n, _ in added)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = begin()
        for batch in batches:
            for piece in grams.pieces(batch.column(at), piece_bytes):
                rows = slice(piece.first, piece.last)
                yield pa.RecordBatch.from_arrays([*(c[rows] for c in batch.columns), *compute(batch, piece)], names)

    return df.mapInArrow(each, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)]))
