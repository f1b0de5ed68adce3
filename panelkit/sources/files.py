"""Files in and out: CSV, JSON lines, text lines, nested splits, vectors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.draws import as_column
from ..functions.text import is_blank, to_number
from ..operators.joins import lookup_join
from .staging import stage


# Texts of a CSV field that stand for a missing value.
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    na_texts: Sequence[str] = NA_TEXTS,
    **options,
) -> DataFrame:
    """Table by suffix: ``.parquet``, else CSV with a header.

    A text field may span lines, so CSV is read in multi-line mode unless
    ``multiLine=False`` is given (then large files are split over tasks).
    NaN, empty fields and the ``na_texts`` become null. Without a schema the
    types are inferred, and a column of numbers and ``na_texts`` is a double;
    that reads the files twice more, so give a schema for large ones.
    """
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith(".parquet"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(*([path] if isinstance(path, str) else path))
    opts = {"header": True, "multiLine": True, "escape": '"', "nanValue": "NaN", **options}
    reader = spark.read.options(**opts)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    table = reader.csv(path if isinstance(path, str) else list(path))
    marked = [n for n, kind in table.dtypes if kind == "string"] if schema is None and na_texts else []
    numbers = set()
    if marked:  # text only because of its marks for missing values: numbers
        bad = [F.count_if(~F.col(c).isin(*na_texts) & to_number(c).isNull()).alias(c) for c in marked]
        numbers = {c for c, n in table.agg(*bad).first().asDict().items() if n == 0}
    cleaned = {}
    for name, kind in table.dtypes:
        if name in numbers:
            number = F.when(~F.col(name).isin(*na_texts), to_number(name))
            cleaned[name] = F.when(~F.isnan(number), number)
        elif kind == "string" and na_texts:
            cleaned[name] = F.when(~F.col(name).isin(*na_texts), F.col(name))
        elif kind in ("double", "float"):
            cleaned[name] = F.when(~F.isnan(name), F.col(name))
    return table.withColumns(cleaned) if cleaned else table


def read_prefix(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def read_json_lines(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_lines_indexed(spark: SparkSession, path: str, out: str = "line_no") -> DataFrame:
    """Text lines with their 0-based position over all files in path order."""
    lines = spark.read.text(path).select(
        F.col("value"), "_metadata.file_path", "_metadata.file_block_start"
    )
    return _number_records(lines, out)


def read_records_indexed(
    spark: SparkSession, path: str, schema: StructType | str, out: str = "rec_no", **options
) -> DataFrame:
    """CSV records with their 0-based position over all files in path order."""
    records = read_table(spark, path, schema, **options)
    return _number_records(
        records.select("*", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")), out
    )


def _number_records(df: DataFrame, out: str) -> DataFrame:
    # A file block is read front to back by one task, so the increasing id is
    # in file order inside the block. It is stored before use: the offsets
    # and the rows must come from the same read.
    block = ["file_path", "file_block_start"]
    stored = stage(df.withColumn("_id", F.monotonically_increasing_id()), "records")
    # One row per file block of a few megabytes or more: a small table, which
    # still goes through the checked join.
    blocks = stored.groupBy(*block).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    joined = lookup_join(stored, offsets, block)
    return joined.withColumn(out, F.col("_before") + F.col("_id") - F.col("_first")).drop(
        *block, "_id", "_first", "_before"
    )


def systematic(df: DataFrame, position: Column | str, every: int) -> DataFrame:
    """Records n, 2n, 3n, ... of a 0-based position column."""
    return df.where((as_column(position) + 1) % every == 0)


def read_nested_splits(
    spark: SparkSession, paths: dict[str, str], schema: StructType | str | None = None
) -> DataFrame:
    """Several Parquet folders as one table with a ``split`` column."""
    out: DataFrame | None = None
    for split, path in paths.items():
        part = read_table(spark, path, schema).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits given")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column."""
    df.write.options(header=True, escape='"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text_corpus(df: DataFrame, path: str, text: str = "text") -> None:
    """One rendered row per line."""
    df.select(text).write.text(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet") -> None:
    """One folder per key value, such as ``task=gpa/strategy=mean/chunk_index=3``."""
    # Rows of a key meet in one task, a very large key in several: few files, no hot task.
    df.hint("rebalance", *keys).write.partitionBy(*keys).format(fmt).save(path)


def save_matrix(df: DataFrame, path: str, key: str, values: str) -> None:
    df.select(key, F.col(values).cast("array<double>").alias(values)).write.parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def drop_blank_lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(text))


def collect_results(
    spark: SparkSession,
    root: str,
    keys: Sequence[str] = ("task", "chunk_index"),
    pattern: str | None = None,
    expected: DataFrame | None = None,
    value: str = "R",
) -> DataFrame:
    """Many one-number files -> one table, the keys taken from the path.

    ``pattern`` has one group per key; by default ``key=value`` folders are
    read. With ``expected`` (the full grid) an absent file is an error.
    """
    pattern = pattern or "/".join(f"{k}=([^/]+)" for k in keys)
    lines = spark.read.option("recursiveFileLookup", True).text(root)
    found = lines.where(~is_blank("value")).select(
        *[
            F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), pattern, i + 1)).alias(k)
            for i, k in enumerate(keys)
        ],
        F.trim("value").cast("double").alias(value),
    )
    if expected is not None:
        absent = remaining_work(expected, found, keys).count()
        if absent:
            raise ValueError(f"{absent} expected results are absent under {root}")
    return found


def remaining_work(
    expected: DataFrame,
    done: DataFrame,
    keys: Sequence[str],
    available: DataFrame | None = None,
    start: Column | None = None,
) -> DataFrame:
    """Work items without a result, whose inputs exist, from ``start`` on."""
    todo = expected if start is None else expected.where(start)
    casts = [F.col(k).cast(dict(expected.dtypes)[k]).alias(k) for k in keys]
    todo = lookup_join(todo, done.select(*casts).distinct(), list(keys), "left_anti")
    if available is not None:
        on: Iterable[str] = [k for k in keys if k in available.columns]
        todo = lookup_join(todo, available.select(*on).distinct(), list(on), "left_semi")
    return todo
