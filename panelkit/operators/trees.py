"""Regression trees of many models at once, grown level by level from histograms.

A model is a combination of keys, such as (chunk_index, task). A row carries the
bin number of each feature, so one aggregation a level counts, for every
model, node, feature and bin, the rows and the sum of their labels; the best
split of each node is picked from these counts, and the rows move on to their
children. Nodes of few rows are finished by one task each, which counts with
arrays. There is no loop over models. Labels are whole numbers (the
caller's values in units of ``1 / SCALE``): their sums are the same in every order, so a
retried task or another engine finds the same splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .joins import fan_out, lookup_join
from .quantiles import rank_steps, value_at

#: Bins of a feature: its values are cut at the ranks k / MAX_BINS.
MAX_BINS = 32
#: Labels and weights are rounded to whole numbers of these units.
SCALE = 1 << 16
WEIGHT_SCALE = 1 << 20
#: Decimal places of the means that stand for missing values.
MEAN_PLACES = 9
#: A node of at most so many rows, whose sums fit 64 bits, is finished by one task.
LOCAL_ROWS = 400_000
#: Nodes whose counts a task holds at once.
HELD_NODES = 4096
#: A booster of at most so many rows, whose sums fit 64 bits, is fitted by one task.
LOCAL_BOOST_ROWS = 2_000_000
#: Tasks that the models fitted by one task each are dealt over, so that few of them meet.
MODEL_TASKS = 64
#: Rows of a task that are counted at once.
BATCH_ROWS = 100_000


def bin_edges(values: DataFrame, keys: Sequence[str], value: str, max_bins: int = MAX_BINS) -> DataFrame:
    """Per key ``edges``, the distinct values at the ranks k / max_bins, ascending."""
    steps = rank_steps(values, keys, value, [k / max_bins for k in range(1, max_bins)])
    rank = lambda k: F.ceil(F.lit(k) * F.col("n_total") / F.lit(max_bins)) - 1
    return steps.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.array(*[value_at(rank(k)) for k in range(1, max_bins)]))).alias("edges"))


def bin_of(value: Column, edges: Column) -> Column:
    """The number of edges below the value: bins up to ``b`` hold the values up to edge ``b``."""
    return F.size(F.filter(edges, lambda e: e < value))


def whole(value: Column, scale: int = SCALE) -> Column:
    return F.round(value * F.lit(float(scale))).cast("long")


def cells_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of each (keys, node, feature, bin): ``n``, the sums ``w`` and ``s`` of w * y, and the node's ``low`` and ``high`` y in the counted batches.

    A batch is counted with arrays, so that Spark adds counts and not a cell for
    each row and feature. Labels are cut into parts of 16 bits, whose sums
    fit 64 bits; a batch where they might not is halved.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "node long, feature int, bin int, n long, w long, s0 long, s1 long, s2 long, low long, high long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                yield from _counted(pa.Table.from_batches(held), keys)
                held = []
        if held:
            yield from _counted(pa.Table.from_batches(held), keys)

    part = rows.select(*keys, F.col("node").cast("long").alias("node"), F.col("bins").cast("array<int>").alias("bins"), F.col("y").cast("long").alias("y"), F.col("w").cast("long").alias("w")).mapInArrow(run, schema)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    added = part.groupBy(*keys, "node", "feature", "bin").agg(
        F.sum("n").alias("n"), total("w").alias("w"), *[total(c).alias(c) for c in ("s0", "s1", "s2")], F.min("low").alias("low"), F.max("high").alias("high")
    )
    s = [F.col(c).cast("decimal(28,0)") * F.lit(1 << 16 * i).cast("decimal(10,0)") for i, c in enumerate(("s0", "s1", "s2"))]
    return added.select(*keys, "node", "feature", "bin", "n", "w", (s[0] + s[1] + s[2]).cast("decimal(38,0)").alias("s"), "low", "high")


def _counted(table: pa.Table, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    y, w, node = (table.column(c).to_numpy() for c in ("y", "w", "node"))
    parts = [y & 0xFFFF, (y >> 16) & 0xFFFF, y >> 32]
    if int(w.max()) * max(1 << 16, int(np.abs(parts[2]).max())) * len(y) >= 1 << 62:
        if len(y) == 1:
            raise ValueError("a weight or label is too large for sums of 64 bits")
        yield from _counted(table.slice(0, len(y) // 2), keys)
        yield from _counted(table.slice(len(y) // 2), keys)
        return
    model = table.select(list(keys)).to_pandas().groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
    _, first, group = np.unique(np.stack([model, node]), axis=1, return_index=True, return_inverse=True)
    group, bins = group.ravel(), table.column("bins").combine_chunks()
    width, flat = pc.list_value_length(bins).to_numpy(), bins.flatten().to_numpy()
    row = np.repeat(np.arange(len(y)), width)
    feature = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
    n_features, n_bins = int(width.max(initial=0)), int(flat.max(initial=0)) + 1
    cell, of_row = np.unique((group[row] * n_features + feature) * n_bins + flat, return_inverse=True)
    out = {"n": np.bincount(of_row, minlength=len(cell))}
    for name, values in (("w", w), *((f"s{i}", w * p) for i, p in enumerate(parts))):
        out[name] = np.zeros(len(cell), dtype=np.int64)
        np.add.at(out[name], of_row, values[row])
    at = cell // (n_features * n_bins)
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
    np.minimum.at(low, group, y)
    np.maximum.at(high, group, y)
    heads = table.select(list(keys)).take(first[at])
    columns = {
        **{k: heads.column(k).combine_chunks() for k in keys}, "node": pa.array(node[first][at]), "feature": pa.array(cell // n_bins % n_features, pa.int32()), "bin": pa.array(cell % n_bins, pa.int32()),
        **{c: pa.array(v, pa.int64()) for c, v in out.items()}, "low": pa.array(low[at]), "high": pa.array(high[at]),
    }
    yield from pa.table(columns).to_batches()


def best_splits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best split of each (keys, node): feature, bin, and sums of both sides.

    ``rows`` hold ``node``, ``bins``, whole numbers ``y`` and ``w``. The split
    that leaves the least squared error is taken, of equal ones the one of the first
    feature and lowest bin, also if it gains nothing. ``feature`` is null in a
    node whose labels are all equal or whose features have one bin each.
    """
    cells = cells_of(rows, keys)
    own = Window.partitionBy(*keys, "node", "feature")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for c in ("n", "w", "s"):
        cells = cells.withColumn(f"{c}_left", F.sum(c).over(upto)).withColumn(f"{c}_all", F.sum(c).over(own))
    left, right = [F.col(f"{c}_left") for c in "ws"], [F.col(f"{c}_all") - F.col(f"{c}_left") for c in "ws"]
    part = lambda side: side[1].cast("double") * side[1].cast("double") / side[0].cast("double")
    ok = (F.col("n_left") < F.col("n_all")) & (left[0] > 0) & (right[0] > 0)
    gain = F.when(ok, part(left) + part(right))
    cells = cells.withColumn("gain", gain)
    order = F.when(ok, F.struct("gain", -F.col("feature"), -F.col("bin")))
    picked = F.struct("feature", "bin", F.col("w_left").alias("w_left"), F.col("s_left").alias("s_left"))
    best = cells.groupBy(*keys, "node").agg(
        F.max("n_all").alias("n"), F.max("w_all").alias("w"), F.max("s_all").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.max_by(F.when(ok, picked), order).alias("best"),
    )
    value = lambda s, w: (s.cast("double") / w.cast("double")).alias
    split = F.when(F.col("low") < F.col("high"), F.col("best"))
    best = best.withColumn("best", split)
    return best.select(
        *keys, "node", "n", value(F.col("s"), F.col("w"))("value"), F.col("best.feature").alias("feature"), F.col("best.bin").alias("bin"),
        value(F.col("best.s_left"), F.col("best.w_left"))("left"),
        value(F.col("s") - F.col("best.s_left"), F.col("w") - F.col("best.w_left"))("right"),
    )


@dataclass
class Grown:
    """Nodes of all trees (keys, node, n, value, feature, bin), and every row with the value of its leaf."""

    nodes: DataFrame
    leaves: DataFrame


def grow(rows: DataFrame, keys: Sequence[str], depth: int) -> Grown:
    """One tree per ``keys``, at most ``depth`` splits deep, learned from the rows marked ``train``; all rows are sent to leaves.

    ``rows`` hold the keys, ``train``, ``bins``, ``y``, ``w`` and any others. A
    level costs one aggregation and one pass that stores the rows still
    under way; rows of nodes with at most ``LOCAL_ROWS`` leave the levels, and
    one last pass finishes all these nodes. Keys without training rows have no tree and their rows no leaf.
    """
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    nodes = leaves = local = None
    for level in range(depth + 1):
        if level:
            sizes = stage(_sizes(rows, keys), "sizes")
            sized = lookup_join(rows, sizes, [*keys, "node"])
            own = sized.where("small").drop("small")
            local = own if local is None else local.unionByName(own)
            if sizes.where("NOT small").isEmpty():
                break
            rows = sized.where("NOT small").drop("small")
        splits = best_splits(rows.where("train"), keys)
        if level == depth:
            splits = splits.withColumn("feature", F.lit(None).cast("int")).withColumn("bin", F.lit(None).cast("int"))
        splits = stage(splits.select(*keys, "node", "n", "value", "feature", "bin"), "splits")
        nodes = splits if nodes is None else nodes.unionByName(splits)
        moved = lookup_join(rows, splits.drop("n"), [*keys, "node"])
        open = F.col("feature").isNotNull()
        ended = moved.where(~open).drop("feature", "bin", "node")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        if level == depth or splits.where(open).isEmpty():
            break
        right = (F.get("bins", F.col("feature")) > F.col("bin")).cast("int")
        rows = stage(moved.where(open).withColumn("node", 2 * F.col("node") + right).drop("feature", "bin", "value"), "level")
    if local is not None:
        done = stage(_finished(local, keys, depth), "finished")
        nodes = nodes.unionByName(done.where("_is_node").select(*nodes.columns))
        leaves = leaves.unionByName(done.where("NOT _is_node").select(*leaves.columns))
    return Grown(nodes, leaves)


def _sizes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each (keys, node) whether one task can finish it: ``small``."""
    largest = F.max(F.abs(F.col("w").cast("double") * F.col("y").cast("double")))
    plain = (F.min(F.size("bins")) == F.max(F.size("bins"))) & ~F.max(F.exists("bins", lambda b: b.isNull()))
    fits = (largest * F.count("*") < float(1 << 62)) & (F.max("w").cast("double") * F.count("*") < float(1 << 62))
    small = F.coalesce((F.count("*") <= LOCAL_ROWS) & plain & fits, F.lit(False))
    return rows.groupBy(*keys, "node").agg(small.alias("small"))


def _finished(rows: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """The subtrees below small nodes: their nodes, and every row with the value of its leaf."""
    carried = [f for f in rows.schema.fields if f.name not in ("node", "value")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)
    names = [f.name for f in carried]

    def finish(table: pa.Table) -> pa.Table:
        array = lambda c: table.column(c).to_numpy()
        bins = table.column("bins").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        found, value = _subtree(bins, array("y"), array("w"), array("train").astype(bool), table.column("node")[0].as_py(), depth)
        n, shown = len(found["node"]), table.select(names)
        empty = {"_is_node": pa.array([False] * table.num_rows), "node": None, "n": None, "value": pa.array(value), "feature": None, "bin": None}
        kinds = {"node": pa.int64(), "n": pa.int64(), "feature": pa.int32(), "bin": pa.int32()}
        ended = [pa.nulls(table.num_rows, kinds[c]) if a is None else a for c, a in empty.items()]
        heads = [pa.array([table.column(c)[0].as_py()] * n, shown.schema.field(c).type) if c in keys else pa.nulls(n, shown.schema.field(c).type) for c in names]
        picked = [pa.array(found[c], kinds.get(c, pa.float64()), mask=found["leaf"] if c in ("feature", "bin") else None) for c in ("node", "n", "value", "feature", "bin")]
        columns = [*names, *empty]
        ended = pa.table([c.combine_chunks() for c in shown.columns] + ended, columns)
        return pa.concat_tables([ended, pa.table([*heads, pa.array([True] * n), *picked], columns)])

    return rows.groupBy(*keys, "node").applyInArrow(finish, f"{kinds}, _is_node boolean, node long, n long, value double, feature int, bin int")


def _subtree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, train: np.ndarray, root: int, depth: int) -> tuple[dict, np.ndarray]:
    """The tree below one node by the rule of ``best_splits``, a level at a time in 64-bit whole numbers; and the value of each row's leaf."""
    out: dict[str, list] = {c: [] for c in ("node", "n", "value", "feature", "bin", "leaf")}
    value = np.zeros(len(y))
    size, product = int(bins.max(initial=0)) + 1, w * y
    here, slot, node = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), np.array([root], dtype=np.int64)
    while len(here):
        k = len(node)
        own = train[here]
        at, in_slot = here[own], slot[own]

        def sums(places: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
            total = np.zeros(n, dtype=np.int64)
            np.add.at(total, places, values[at])
            return total

        n_all, w_all, s_all = np.bincount(in_slot, minlength=k), sums(in_slot, k, w), sums(in_slot, k, product)
        low, high = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
        np.minimum.at(low, in_slot, y[at])
        np.maximum.at(high, in_slot, y[at])
        best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, dtype=np.int64)
        if int(node[0]).bit_length() <= depth:
            order = np.argsort(in_slot, kind="stable")
            ends = np.concatenate([[0], np.cumsum(n_all)])
            for first in range(0, k, HELD_NODES):
                few = slice(first, min(first + HELD_NODES, k))
                own = at[order[ends[few.start] : ends[few.stop]]]
                base = (in_slot[order[ends[few.start] : ends[few.stop]]] - first) * size
                best[few], feature[few], cut[few] = _best_of(bins[own], base, w[own], product[own], n_all[few], w_all[few], s_all[few], size)
        leaf = (feature < 0) | (low >= high)
        mean = s_all.astype(float) / w_all.astype(float)
        for c, found in zip(out, (node, n_all, mean, feature, cut, leaf)):
            out[c].append(found)
        ended = leaf[slot]
        value[here[ended]] = mean[slot[ended]]
        here, slot = here[~ended], slot[~ended]
        right = bins[here, feature[slot]] > cut[slot]
        node, slot = np.unique(2 * node[slot] + right, return_inverse=True)
    return {c: np.concatenate(found) for c, found in out.items()}, value


def _best_of(bins: np.ndarray, base: np.ndarray, w: np.ndarray, product: np.ndarray, n_all: np.ndarray, w_all: np.ndarray, s_all: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best split of each node; feature -1 where there is none. ``base`` is the node's place times ``size``."""
    k = len(n_all)
    best, feature, cut = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, dtype=np.int64)

    def sums(places: np.ndarray, values: np.ndarray) -> np.ndarray:
        total = np.zeros(k * size, dtype=np.int64)
        np.add.at(total, places, values)
        return total.reshape(k, size)

    for f in range(bins.shape[1]):
        cell = base + bins[:, f]
        n = np.bincount(cell, minlength=k * size).reshape(k, size)
        nl, wl, sl = (np.cumsum(c, axis=1) for c in (n, sums(cell, w), sums(cell, product)))
        wr, sr = w_all[:, None] - wl, s_all[:, None] - sl
        ok = (n > 0) & (nl < n_all[:, None]) & (wl > 0) & (wr > 0)
        part = lambda s, w: s.astype(float) * s.astype(float) / np.where(ok, w, 1).astype(float)
        gain = np.where(ok, part(sl, wl) + part(sr, wr), -np.inf)
        b = gain.argmax(axis=1)
        top = gain[np.arange(k), b]
        better = top > best
        best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, b, cut)
    return best, feature, cut


def chunk_rows(cells: DataFrame, chunk_features: Mapping[int, Sequence[str]], max_bins: int = MAX_BINS) -> tuple[DataFrame, DataFrame]:
    """Rows (chunk_index, id, task, diff, bins) of regression cells, and the bin edges of (chunk_index, feature).

    A missing value counts as the feature's mean over the ids, rounded to
    ``MEAN_PLACES``. A chunk with a feature without any value has no rows. The list of a row has
    the width of its chunk.
    """
    spark = cells.sparkSession
    places = spark.createDataFrame([(c, f, i) for c, fs in chunk_features.items() for i, f in enumerate(fs)], "chunk_index long, feature string, place int")
    width = spark.createDataFrame([(c, len(fs)) for c, fs in chunk_features.items()], "chunk_index long, width int")
    # Both have a row for each feature of a chunk at most; they are made from the caller's list.
    listed = cells.join(F.broadcast(places), ["chunk_index", "feature"])
    one = listed.groupBy("chunk_index", "id", "place").agg(F.first("value", ignorenulls=True).alias("value"))
    wide = stage(one.groupBy("chunk_index", "id").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("own")), "wide")
    single = wide.select("chunk_index", F.explode("own").alias("place", "value"))
    means = single.groupBy("chunk_index", "place").agg(F.round(F.avg("value"), MEAN_PLACES).alias("mean"))
    edges = stage(bin_edges(single, ["chunk_index", "place"], "value", max_bins).join(means, ["chunk_index", "place"]), "edges")
    # One row per chunk: a list of its features' edges and means, in order.
    whole_chunk = edges.groupBy("chunk_index").agg(F.array_sort(F.collect_list(F.struct("place", "edges", "mean"))).alias("binning")).join(F.broadcast(width), "chunk_index")
    whole_chunk = stage(whole_chunk.where(F.size("binning") == F.col("width")).drop("width"), "binning")
    binned = F.transform("binning", lambda b: bin_of(F.coalesce(F.try_element_at(F.col("own"), b["place"]), b["mean"]), b["edges"]))
    ids = lookup_join(wide, whole_chunk, ["chunk_index"]).select("chunk_index", "id", binned.alias("bins"))
    tasks = cells.select("chunk_index", "id", "task", "diff").where("diff is not null").distinct()
    named = edges.join(F.broadcast(places), ["chunk_index", "place"]).select("chunk_index", F.col("place").alias("at"), "feature", "edges")
    return fan_out(ids, tasks, ["chunk_index", "id"], "tasks_of"), named


def _arrays(nodes: dict, depth: int) -> tuple[list, list, list]:
    """Features, bins and values of a shallow tree by node number; a leaf has no feature."""
    size = 1 << (depth + 1)
    feature, at, value = [None] * size, [None] * size, [None] * size
    for i, r in sorted(nodes.items()):
        feature[i], at[i] = r.feature, r.bin
        if r.feature is None:
            value[i] = r.value
        else:
            value[2 * i], value[2 * i + 1] = r.left, r.right
    return feature, at, value


def _walk(feature: Column, at: Column, levels: int) -> Column:
    """The node that a row reaches after so many splits, or the leaf where it ends before."""
    right = lambda n: (F.get("bins", F.get(feature, n)) > F.get(at, n)).cast("int")
    step = lambda n, _: F.when(F.get(feature, n).isNull(), n).otherwise(2 * n + right(n))
    return F.aggregate(F.array_repeat(F.lit(0), levels), F.lit(1), step)


def _by_model(found: list, keys: Sequence[str]) -> dict[tuple, dict]:
    out: dict[tuple, dict] = {}
    for r in found:
        out.setdefault(tuple(r[k] for k in keys), {})[r.node] = r
    return out


_TREE = "feature array<int>, bin array<int>, value array<double>"


def _node_cells(bins: np.ndarray, slot: np.ndarray, w: np.ndarray, products: list[np.ndarray], k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums of weights, and exact sums of weight times label as Python's whole numbers, of each (node, feature, bin)."""
    n, ws = (np.zeros((k, len(bins), size), dtype=np.int64) for _ in range(2))
    parts = [np.zeros((k, len(bins), size), dtype=np.int64) for _ in products]
    base = slot * size
    for f, own in enumerate(bins):
        cell = base + own
        n[:, f] = np.bincount(cell, minlength=k * size).reshape(k, size)
        for out, values in ((ws, w), *zip(parts, products)):
            total = np.zeros(k * size, dtype=np.int64)
            np.add.at(total, cell, values)
            out[:, f] = total.reshape(k, size)
    return n, ws, sum(p.astype(object) * (1 << 16 * i) for i, p in enumerate(parts))


def _boosted(bins: np.ndarray, y: np.ndarray, rounds: int, rate: float, depth: int) -> list[tuple]:
    """One booster by the rules of ``best_splits`` and ``Boosted``: (round, node, n, value, feature, bin, left, right, weight of the tree)."""
    out: list[tuple] = []
    size, weight = int(bins.max(initial=0)) + 1, np.ones(len(y))
    cut = [y & 0xFFFF, (y >> 16) & 0xFFFF, y >> 32]
    double = lambda c: c.astype(float)
    for number in range(rounds):
        scaled = weight * WEIGHT_SCALE
        low = np.floor(scaled)
        w = np.maximum((low + (scaled - low >= 0.5)).astype(np.int64), 1)
        products = [w * c for c in cut]
        nodes: list[tuple] = []
        node, value = np.ones(len(y), dtype=np.int64), np.full(2 << depth, np.nan)
        here = np.arange(len(y))
        for level in range(depth):
            if not len(here):
                break
            k, all_rows = 1 << level, len(here) == len(y)
            slot = node[here] - k
            n, ws, s = _node_cells(bins if all_rows else bins[:, here], slot, w[here], [p[here] for p in products], k, size)
            nl, wl, sl = (np.cumsum(c, axis=2) for c in (n, ws, s))
            n_all, w_all, s_all = (c[:, 0, -1] for c in (nl, wl, sl))
            wr, sr = w_all[:, None, None] - wl, s_all[:, None, None] - sl
            ok = (n > 0) & (nl < n_all[:, None, None]) & (wl > 0) & (wr > 0)
            part = lambda s, w: double(s) * double(s) / np.where(ok, w, 1).astype(float)
            gain = np.where(ok, part(sl, wl) + part(sr, wr), -np.inf).reshape(k, -1)
            best = gain.argmax(axis=1)
            least, most = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
            np.minimum.at(least, slot, y[here])
            np.maximum.at(most, slot, y[here])
            feature, place = np.divmod(best, size)
            is_open = (gain[np.arange(k), best] > -np.inf) & (least < most)
            for i in np.flatnonzero(n_all):
                own = value[k + i] = float(s_all[i]) / float(w_all[i])
                f, b = int(feature[i]), int(place[i])
                if is_open[i]:
                    value[2 * (k + i)] = float(sl[i, f, b]) / float(wl[i, f, b])
                    value[2 * (k + i) + 1] = float(sr[i, f, b]) / float(wr[i, f, b])
                    nodes.append((k + int(i), int(n_all[i]), own, f, b, value[2 * (k + i)], value[2 * (k + i) + 1]))
                else:
                    nodes.append((k + int(i), int(n_all[i]), own, None, None, None, None))
            going = is_open[slot]
            here, slot = here[going], slot[going]
            node[here] = 2 * node[here] + (bins[feature[slot], here] > place[slot])
        error = np.abs(y - value[node])
        worst, total = float(error.max()), float(weight.sum())
        loss = float((weight * error).sum()) / worst / total if worst else 0.0
        if not worst or loss >= 0.5:
            # The model ends here; its last tree counts only if it is perfect or the only one.
            if not worst or number == 0:
                out += [(number, *r, 1.0) for r in nodes]
            break
        beta = loss / (1 - loss)
        out += [(number, *r, rate * math.log(1 / beta)) for r in nodes]
        weight = weight * (len(y) / total) * np.power(beta, (1 - error / worst) * rate)
    return out


class Boosted:
    """AdaBoost.R2 (Drucker 1997, linear loss) of shallow trees, one booster per ``keys``.

    Models of few rows are fitted by one task each; the others are grown in the same rounds. A round's trees are a table with a row for each of ``keys``, joined to the
    rows as a broadcast: its size is the number of models, known beforehand.
    """

    def __init__(self, keys: Sequence[str], rounds: int, rate: float, depth: int) -> None:
        self.keys, self.rounds, self.rate, self.depth = list(keys), rounds, rate, depth
        #: For each round the nodes of its trees, and the weight of each model's tree.
        self.trees: list[list] = []
        self.weights: list[dict[tuple, float]] = []

    def _table(self, rows: DataFrame, values: list[tuple], fields: str) -> DataFrame:
        kinds = dict(rows.dtypes)
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in self.keys), fields])
        return F.broadcast(rows.sparkSession.createDataFrame(values, schema))

    def _with_trees(self, rows: DataFrame, found: list) -> DataFrame:
        return rows.join(self._table(rows, [(*m, *_arrays(n, self.depth)) for m, n in _by_model(found, self.keys).items()], _TREE), self.keys)

    def _grown(self, rows: DataFrame) -> list:
        """The nodes of one shallow tree per ``keys``, at most ``2 ** depth - 1`` each; no level is stored."""
        found = list(best_splits(rows.withColumn("node", F.lit(1).cast("long")), self.keys).toLocalIterator())
        for level in range(1, self.depth):
            node = _walk(F.col("feature"), F.col("bin"), level).cast("long")
            here = self._with_trees(rows, found).withColumn("node", node).drop("feature", "bin", "value")
            found += best_splits(here.where(F.col("node") >= 1 << level), self.keys).toLocalIterator()
        return found

    def fit(self, rows: DataFrame) -> Boosted:
        """``rows`` hold the keys, ``bins`` and whole numbers ``y``.

        A model of at most ``LOCAL_BOOST_ROWS`` is fitted through all its rounds
        by one task. The others share their rounds, of which each stores the
        rows' weights, and so costs at most itself if executors are lost.
        """
        rows = stage(rows.select(*self.keys, "bins", "y"), "boost")
        # One row for each model; a null key has none.
        sizes = stage(rows.groupBy(*self.keys).agg(self._fits().alias("small")), "boost_sizes")
        sized = rows.join(F.broadcast(sizes), self.keys)
        if not sizes.where("small").isEmpty():
            self._fit_local(sized.where("small").select(*self.keys, "bins", "y"))
        if not sizes.where("NOT small").isEmpty():
            self._fit_shared(sized.where("NOT small").select(*self.keys, "bins", "y"))
        return self

    @staticmethod
    def _fits() -> Column:
        """Whether one task can fit the model: its rows, and sums of its weights and labels in 64 bits."""
        plain = (F.min(F.size("bins")) == F.max(F.size("bins"))) & (F.min(F.size("bins")) > 0) & ~F.max(F.exists("bins", lambda b: b.isNull()))
        return F.coalesce((F.count("*") <= LOCAL_BOOST_ROWS) & plain & (F.max(F.abs(F.col("y").cast("double"))) < float(1 << 51)), F.lit(False))

    def _add(self, number: int, nodes: list, own: dict[tuple, float]) -> None:
        while len(self.trees) <= number:
            self.trees.append([])
            self.weights.append({})
        self.trees[number] += nodes
        self.weights[number].update(own)

    def _fit_local(self, rows: DataFrame) -> None:
        kinds = dict(rows.dtypes)
        schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in self.keys), "round int, node long, n long, value double, feature int, bin int, left double, right double, weight double"])
        keys, rounds, rate, depth = self.keys, self.rounds, self.rate, self.depth

        def fit(table: pa.Table) -> pa.Table:
            bins = table.column("bins").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            found = _boosted(np.ascontiguousarray(bins.T), table.column("y").to_numpy(), rounds, rate, depth)
            columns = {k: pa.array([table.column(k)[0].as_py()] * len(found), table.schema.field(k).type) for k in keys}
            names = {"round": pa.int32(), "node": pa.int64(), "n": pa.int64(), "value": pa.float64(), "feature": pa.int32(), "bin": pa.int32(), "left": pa.float64(), "right": pa.float64(), "weight": pa.float64()}
            return pa.table({**columns, **{c: pa.array([r[i] for r in found], kind) for i, (c, kind) in enumerate(names.items())}})

        own = rows.withColumn("bins", F.col("bins").cast("array<int>")).repartition(MODEL_TASKS, *keys)
        # At most ``2 ** depth - 1`` nodes for each model and round.
        for r in own.groupBy(*keys).applyInArrow(fit, schema).toLocalIterator():
            self._add(r["round"], [r], {tuple(r[k] for k in keys): r.weight})

    def _fit_shared(self, rows: DataFrame) -> None:
        rows = stage(rows.withColumn("weight", F.lit(1.0)), "boost")
        for number in range(self.rounds):
            found = self._grown(rows.withColumn("w", F.greatest(F.round(F.col("weight") * WEIGHT_SCALE).cast("long"), F.lit(1))))
            if not found:
                break
            value = F.get("value", _walk(F.col("feature"), F.col("bin"), self.depth))
            scored = stage(self._with_trees(rows, found).withColumn("error", F.abs(F.col("y") - value)).drop("feature", "bin", "value"), "boost")
            stats = scored.groupBy(*self.keys).agg(
                F.max("error").alias("worst"), F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("error")).alias("sum"), F.count("*").alias("n")
            ).toLocalIterator()
            own: dict[tuple, float] = {}
            factors: list[tuple] = []
            for s in stats:
                model = tuple(s[k] for k in self.keys)
                loss = s["sum"] / s.worst / s.total if s.worst else 0.0
                if not s.worst or loss >= 0.5:
                    # The model ends here; its last tree counts only if it is perfect or the only one.
                    if not s.worst or number == 0:
                        own[model] = 1.0
                    continue
                beta = loss / (1 - loss)
                own[model] = self.rate * math.log(1 / beta)
                # The factor leaves the mean weight near 1.
                factors.append((*model, s.worst, beta, s.n / s.total))
            self._add(number, [r for r in found if tuple(r[k] for k in self.keys) in own], own)
            if not factors:
                break
            power = (1 - F.col("error") / F.col("worst")) * F.lit(self.rate)
            rows = scored.join(self._table(rows, factors, "worst double, beta double, factor double"), self.keys)
            rows = rows.withColumn("weight", F.col("weight") * F.col("factor") * F.pow("beta", power)).drop("error", "worst", "beta", "factor")

    def predict(self, rows: DataFrame, out: str) -> DataFrame:
        """The weighted median of the trees' values, turned back from units of ``1 / SCALE``; null for keys without a booster."""
        forests: dict[tuple, list] = {}
        for found, own in zip(self.trees, self.weights):
            for model, nodes in _by_model(found, self.keys).items():
                forests.setdefault(model, []).append((*_arrays(nodes, self.depth), own[model]))
        depth = self.depth
        forest = {m: _Forest(sorted(f, key=lambda t: t[3])) for m, f in forests.items()}

        def vote(bins: pa.Array, *keys: pa.Array) -> pa.Array:
            models = list(zip(*(k.to_pylist() for k in keys)))
            of: dict[tuple, list] = {}
            for i, m in enumerate(models):
                of.setdefault(m, []).append(i)
            width = pc.list_value_length(bins).to_numpy(zero_copy_only=False).astype(np.int64)
            places = np.zeros((len(bins), int(width.max(initial=0))), dtype=np.int64)
            row = np.repeat(np.arange(len(bins)), width)
            places[row, np.arange(len(row)) - (np.cumsum(width) - width)[row]] = bins.flatten().to_numpy(zero_copy_only=False)
            found, known = np.zeros(len(bins)), np.zeros(len(bins), dtype=bool)
            for m, some in of.items():
                if m in forest and None not in m:
                    found[some], known[some] = forest[m].median(places[some], depth), True
            return pa.array(found / SCALE, mask=~known)

        return rows.withColumn(out, F.arrow_udf(vote, "double")("bins", *self.keys))


class _Forest:
    """The trees of a model, ascending by weight."""

    def __init__(self, trees: list[tuple]) -> None:
        number = lambda lists, none, kind: np.array([[none if v is None else v for v in own] for own in lists], dtype=kind)
        self.feature, self.bin = number([t[0] for t in trees], -1, np.int64), number([t[1] for t in trees], 0, np.int64)
        self.value, self.weight = number([t[2] for t in trees], np.nan, float), np.array([t[3] for t in trees])

    def median(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The weighted median of the trees' values for each row."""
        every, votes = np.arange(len(bins)), np.empty((len(bins), len(self.weight)))
        for i, (feature, cut, value) in enumerate(zip(self.feature, self.bin, self.value)):
            node = np.ones(len(bins), dtype=np.int64)
            for _ in range(levels):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + (bins[every, f] > cut[node]))
            votes[:, i] = value[node]
        # Equal values stay in the order of their weights.
        order = np.argsort(votes, axis=1, kind="stable")
        upto = np.cumsum(self.weight[order], axis=1)
        first = (upto >= upto[:, -1:] / 2 * (1 - 1e-12)).argmax(axis=1)
        return votes[every, order[every, first]]
