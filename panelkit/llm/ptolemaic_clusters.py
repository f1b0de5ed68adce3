"""Centroid clustering of vectors, pruned by Ptolemy's inequality.

Vectors become integers, so sums, means and distances are exact and a run gives
the same clusters on any cluster. The starting centroids also serve as pivots.
Every vector keeps its distances to the pivots; for a pair of pivots ``s, t``
Ptolemy's inequality bounds the distance of ``x`` to a centroid ``c`` below by
``|d(x,s) d(c,t) - d(x,t) d(c,s)| / d(s,t)``. The bound is rounded down by more
than all rounding errors together; centroids that it cannot rule out are
compared by exact integer distances. A round is one map over the stored vectors
that returns a sum for each task and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage

CLUSTERS = 16
ROUNDS = 3
WIDTH = 64
SCALE = 64
#: Relative allowance for all roundings of a bound, far above the few units in the last place they sum to.
SLACK = 2.0**-40
#: Vectors compared at once.
STEP = 8_192
#: Components up to this size have squared distances that fit 64 bits at any width up to 2**11.
_SMALL = 1 << 25


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; beyond the range of 64 bits in Python's integers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) > _SMALL or x.shape[1] > 2048:
        return ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


@dataclass
class Pivots:
    """Pivot vectors and the pairs of them that give bounds, with the pair's distance."""

    at: np.ndarray
    pairs: list[tuple[int, int, float]]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_roots(_squares(x, p[None, :])) for p in self.at], axis=1)


def choose_pairs(at: np.ndarray) -> Pivots:
    """Each pivot with the pivot farthest from it; equal pivots make no pair."""
    pairs: dict[tuple[int, int], float] = {}
    for s in range(len(at)):
        d = _roots(_squares(at, at[s][None, :]))
        t = int(np.argmax(d))
        if d[t] > 0:
            pairs[min(s, t), max(s, t)] = float(d[t])
    return Pivots(at, [(s, t, d) for (s, t), d in pairs.items()])


def lower_bounds(pivots: Pivots, x_distances: np.ndarray, c_distances: np.ndarray) -> np.ndarray:
    """Squared lower bounds of all vectors to all centroids, never above the true squares."""
    out = np.zeros((len(x_distances), len(c_distances)))
    for s, t, d in pivots.pairs:
        a = x_distances[:, s, None] * c_distances[None, :, t]
        b = x_distances[:, t, None] * c_distances[None, :, s]
        np.maximum(out, (np.abs(a - b) - (a + b) * SLACK) * ((1 - SLACK) / d), out=out)
    return out * out * (1 - SLACK)


def nearest(pivots: Pivots, x: np.ndarray, x_distances: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector, the smaller number on a tie, its squared distance, and how many were computed."""
    bounds = lower_bounds(pivots, x_distances, pivots.distances(centroids))
    cluster = np.argmin(bounds, axis=1)
    best = _squares(x, centroids[cluster])
    first, done = cluster.copy(), len(x)
    for c in range(len(centroids)):
        todo = np.flatnonzero((bounds[:, c] <= best.astype(np.float64)) & (first != c))
        d = _squares(x[todo], centroids[c][None, :])
        done += len(todo)
        better = (d < best[todo]) | ((d == best[todo]) & (c < cluster[todo]))
        cluster[todo[better]], best[todo[better]] = c, d[better]
    return cluster, best, done


def integer_vectors(df: DataFrame, id: str, vector: str, width: int, scale: int) -> DataFrame:
    """``id, x`` of the vectors with ``width`` components, none null or non-finite."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) == width) & ~bad)
    return kept.select(F.col(id).alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("x"))


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _assigned(batch: pa.RecordBatch, pivots: Pivots, centroids: np.ndarray, width: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    x, own = _rows(batch, "x", width), _rows(batch, "pivot_distances", len(pivots.at))
    for at in range(0, len(x), STEP):
        rows = slice(at, at + STEP)
        yield rows, x[rows], *nearest(pivots, x[rows], own[rows], centroids)[:2]


def _means(vectors: DataFrame, pivots: Pivots, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after one round; one without vectors stays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), object)
        for batch in batches:
            for _, x, cluster, _ in _assigned(batch, pivots, centroids, width):
                n += np.bincount(cluster, minlength=len(n))
                for c in np.unique(cluster):
                    sums[c] += (x[cluster == c] if np.abs(x).max() <= _SMALL else x[cluster == c].astype(object)).sum(axis=0)
        used = np.flatnonzero(n)
        lists = pa.array([[int(s) for s in sums[c]] for c in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists], ["cluster", "n", "sums"])

    parts = vectors.mapInArrow(each, "cluster int, n long, sums array<long>")
    cells = parts.select("cluster", "n", F.posexplode("sums").alias("component", "part"))
    # At most clusters x components rows, whatever the data.
    totals = cells.groupBy("cluster", "component").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).toLocalIterator()
    out = centroids.copy()
    for r in totals:
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def _element(values: list, kind: str, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), at + 1)


def cluster(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE, clusters: int = CLUSTERS,
    rounds: int = ROUNDS, seed: int = 1,
) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` of every usable vector.

    A vector of another length, or with a null, infinite or undefined
    component, is left out; a component ``x`` counts as ``floor(scale * x)``.
    The start is the ``clusters`` vectors with the smallest sha256 of
    ``seed:id``; vectors that share an id are ordered by their components, a
    null id comes last. With fewer vectors there are fewer centroids. ``distance`` is squared;
    one that a long cannot hold is an error. Repeated rows are clustered each
    for itself; an empty table gives no rows; other columns are not carried.
    """
    spark = df.sparkSession
    kept = integer_vectors(df, id, vector, width, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = list(kept.orderBy(order.asc_nulls_last(), "x").limit(clusters).toLocalIterator())
    kind = dict(df.dtypes)[id]
    if not start:
        return spark.createDataFrame([], f"`{id}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r.x for r in start], np.int64).reshape(-1, width)
    pivots = choose_pairs(centroids)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "x", width)
            d = np.concatenate([pivots.distances(x[at : at + STEP]) for at in range(0, len(x), STEP)] or [np.zeros((0, len(pivots.at)))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(pivots.at)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), lists], ["id", "x", "pivot_distances"])

    vectors = stage(kept.mapInArrow(measured, f"id {kind}, x array<long>, pivot_distances array<double>"), "vectors")
    for _ in range(rounds):
        centroids = _means(vectors, pivots, centroids, width)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, number, distance in _assigned(batch, pivots, centroids, width):
                yield pa.RecordBatch.from_arrays([batch.column("id")[rows], pa.array(number.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["id", "cluster", "distance"])

    assigned = stage(vectors.mapInArrow(final, f"id {kind}, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.total) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).toLocalIterator()}
    at = F.col("cluster")
    return assigned.select(
        F.col("id").alias(id), "cluster", "distance", _element([sums.get(c, 0) for c in range(len(centroids))], "bigint", at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(F.array(*[F.array(*[F.lit(int(v)) for v in c]) for c in centroids]).cast("array<array<bigint>>"), at + 1).alias("centroid"),
    )
