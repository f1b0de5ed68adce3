"""Spark ML baselines, trees and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.staging import stage
from . import trees
from .joins import lookup_join

# Fixed values of the boosting job.
BOOST_ROUNDS = 50
BOOST_RATE = 0.01
BOOST_DEPTH = 3
# The original tree has no limit; nodes are numbered by 64-bit paths.
TREE_DEPTH = 30


def assemble(df: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def ols(
    train: DataFrame, features: Sequence[str], label: str, key: str | None = None,
    include_id: bool = False,
) -> LinearRegressionModel:
    """Least squares; the id is a feature only on request."""
    cols = [*features, key] if include_id and key else list(features)
    fitter = LinearRegression(
        featuresCol="_x", labelCol=label, solver="normal", predictionCol="prediction"
    )
    return fitter.fit(assemble(train, cols))


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(df, features)).drop("_x")


def ols_score(model: LinearRegressionModel) -> float:
    """In-sample R2 of the fit."""
    return model.summary.r2


def score_batches(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    out: str = "score",
) -> DataFrame:
    """Score rows with any model, in Arrow batches.

    ``load`` runs once per task and returns the scorer of one batch.
    """
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for batch in batches:
            yield batch.assign(**{out: scorer(batch).astype("float64")})

    return df.mapInPandas(run, schema)


def score_by_model(
    df: DataFrame, model_key: Sequence[str], spread: Sequence[str],
    load: Callable[..., Callable[[pd.DataFrame], pd.Series]], out: str = "score",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Score each row with the model of its key, such as one per (task, chunk).

    ``load(*key)`` returns the scorer of one model. Rows are ranged by the key
    and ``spread``: a task meets few models and holds one at a time, and the
    rows of a frequent model still go to many tasks. ``df`` should be stored,
    as ranging reads it twice. With ``keep`` only these columns come back with
    the score; what a model reads, such as a text, is then not sent twice.
    """
    key = list(model_key)
    kept = df.columns if keep is None else list(keep)
    schema = StructType([*[df.schema[c] for c in kept], StructField(out, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, scorer = None, None
        for batch in batches:
            for found, part in batch.groupby(key, sort=False, dropna=False):
                if scorer is None or found != held:
                    held, scorer = found, load(*found)
                yield part[kept].assign(**{out: scorer(part).astype("float64")})

    return df.repartitionByRange(*key, *spread).sortWithinPartitions(*key).mapInPandas(run, schema)


def linear_scorer(vector: str, weights: Sequence[float], bias: float = 0.0):
    """Loader for ``score_batches``: a linear model over a vector column."""

    def load():
        import numpy as np

        w = np.asarray(weights, dtype="float64")

        def score(batch: pd.DataFrame) -> pd.Series:
            if batch.empty:
                return pd.Series([], dtype="float64")
            return pd.Series(np.vstack(batch[vector].to_numpy()).astype("float64") @ w + bias, index=batch.index)

        return score

    return load


def tree_splits(
    cells: DataFrame, chunk_features: Mapping[int, Sequence[str]], train: Column, depth: int = TREE_DEPTH, max_bins: int = trees.MAX_BINS,
) -> tuple[DataFrame, DataFrame]:
    """One regression tree per (chunk, task): its nodes, and every row with the value of its leaf.

    Nodes are (chunk_index, task, node, n, value, feature, threshold); rows with
    the feature up to the threshold go to node ``2 * node``, others to the next. Leaves are
    (chunk_index, task, id, train, diff, prediction).
    """
    rows, edges = trees.chunk_rows(cells, chunk_features, max_bins)
    rows = stage(rows.select("chunk_index", "task", "id", "diff", "bins", train.alias("train"), trees.whole(F.col("diff")).alias("y"), F.lit(1).cast("long").alias("w")), "tree_rows")
    grown = trees.grow(rows, ["chunk_index", "task"], depth)
    back = F.col("value") / trees.SCALE
    leaves = grown.leaves.select("chunk_index", "task", "id", "train", "diff", back.alias("prediction"))
    names = stage(edges.withColumnRenamed("at", "feature_at"), "names")
    nodes = lookup_join(grown.nodes.withColumnRenamed("feature", "feature_at"), names, ["chunk_index", "feature_at"], "left")
    return nodes.select("chunk_index", "task", "node", "n", back.alias("value"), "feature", F.get("edges", F.col("bin")).alias("threshold")), leaves


def tree_per_chunk(
    cells: DataFrame, chunk_features: Mapping[int, Sequence[str]], train: Column, depth: int = TREE_DEPTH, max_bins: int = trees.MAX_BINS,
) -> DataFrame:
    """One regression tree per (chunk, task), and its mean absolute error on the rest.

    ``cells`` is (chunk_index, id, task, feature, value, diff, ...); ``train``
    tells the training ids. All trees grow together, one aggregation a level.
    A tree without other rows is not listed.
    """
    _, leaves = tree_splits(cells, chunk_features, train, depth, max_bins)
    gap = F.abs(F.col("diff") - F.col("prediction"))
    return leaves.where(~F.col("train")).groupBy("chunk_index", "task").agg(F.count("*").alias("n_test"), F.avg(gap).alias("mae"))


def boosted_correction(
    train: DataFrame, test: DataFrame, features: Sequence[str], rounds: int = BOOST_ROUNDS, rate: float = BOOST_RATE, depth: int = BOOST_DEPTH,
) -> tuple[trees.Boosted, DataFrame]:
    """A booster per task, fitted on (task, diff, features...), and the test rows with ``predicted_diff``.

    The bins of a feature come from the training rows of all tasks. A null feature is an error.
    """
    names = list(features)
    long = train.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("place", "value"))
    edges = stage(trees.bin_edges(long, ["place"], "value"), "edges")
    # One row for each feature.
    found = {r.place: r.edges for r in edges.toLocalIterator()}
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(F.raise_error(F.lit(f"{c} is null")).cast("double"))
    bins = F.array(*[trees.bin_of(known(c), F.lit(found.get(i, [])).cast("array<double>")) for i, c in enumerate(names)]).alias("bins")
    model = trees.Boosted(["task"], rounds, rate, depth).fit(train.where("diff is not null").select("task", bins, trees.whole(F.col("diff")).alias("y")))
    return model, model.predict(test.withColumn("bins", bins), "predicted_diff").drop("bins")
