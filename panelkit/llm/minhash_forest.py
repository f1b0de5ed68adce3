"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document has one signature of ``TREES * DEPTH`` minima. A tree sorts the
documents by the signature read from its own place on; documents whose longest
common prefix reaches ``DEPTH`` share a region of that tree. Candidates come in
three steps:

1. next neighbours in the sorted order of the first trees, the longest common
   prefixes around a document; a region with many rows goes deeper before it is
   sorted. Confirmed neighbours give first components.
2. next neighbours in all trees, among documents that can still be similar to
   another: a set whose shingles are mostly its own cannot.
3. all pairs that share a region of any tree and are not in one component yet.
   Copies of one text have met by then, so a large group costs its stragglers
   times its size, not its square.

A pair with similarity 0.8 misses one region of depth 5 with probability 0.67
and all 32 with less than 4 in a million. Every link is confirmed on the full
shingle sets. Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grams
from .components import components
from .store import stage

TREES = 32
DEPTH = 5
#: Trees whose neighbours are taken first, and minima below ``DEPTH`` that order a region.
FIRST_TREES = 8
BELOW = 4
#: Rows of a region that are sorted in one piece; a larger region goes deeper, then into pieces.
REGION_ROWS = 10_000
#: Bits of the 128-bit sketch in which similar sets may differ: 12.8 expected at 0.8, so 36 is 6.8 deviations off.
SKETCH_RADIUS = 36

_seeds = grams.mix(np.arange(1, 2 * (TREES * DEPTH + 128) + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_FACTORS = _seeds[: TREES * DEPTH + 128] | np.uint64(1)
_SHIFTS = _seeds[TREES * DEPTH + 128 :]


def shingle_sets(piece: grams.Piece, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and where each document's begin."""
    data = grams.LOWER[piece.data]
    spans = grams.words(piece)
    sums = grams.prefix(grams.word_hashes(data, spans))
    bounds = spans.bounds
    hashes = grams.gram_hash(sums, width)
    ok = grams.runs_inside(bounds, width, len(spans))
    at = np.flatnonzero(ok)
    row = np.searchsorted(bounds, at, "right") - 1
    hashes = hashes[at]
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        hashes = np.concatenate([hashes, grams.slice_hash(sums, bounds[short], bounds[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Size, 128-bit set hash, regions, deeper orders and sketch of every document; empty sets have no region."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                hashes, bounds = shingle_sets(piece, width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                starts = bounds[full]
                minima = np.zeros((len(full), TREES * DEPTH), np.uint64)
                bits = np.zeros((len(full), 128), np.uint8)
                s1 = s2 = np.zeros(0, np.uint64)
                if len(full):
                    for j in range(TREES * DEPTH):
                        minima[:, j] = np.minimum.reduceat(hashes * _FACTORS[j] + _SHIFTS[j], starts)
                    # Sketch bits come from further minima, so they are independent of the regions.
                    for j in range(128):
                        f = TREES * DEPTH + j
                        bits[:, j] = grams.mix(np.minimum.reduceat(hashes * _FACTORS[f] + _SHIFTS[f], starts)) & np.uint64(1)
                    s1 = np.add.reduceat(grams.mix(hashes ^ _SHIFTS[0]), starts)
                    s2 = np.add.reduceat(grams.mix(hashes ^ _SHIFTS[1]), starts)
                regions = np.zeros((len(full), TREES), np.uint64)
                below = np.zeros((len(full), TREES), np.uint64)
                for t in range(TREES):
                    key = np.full(len(full), t + 1, np.uint64)
                    for j in range(DEPTH):
                        key = grams.mix(key * np.uint64(31) + minima[:, t * DEPTH + j])
                    regions[:, t] = key
                    for j in range(BELOW):
                        below[:, t] = below[:, t] << np.uint64(16) | minima[:, ((t + 1) * DEPTH + j) % (TREES * DEPTH)] >> np.uint64(48)
                packed = np.packbits(bits, axis=1).view(np.uint64).reshape(len(full), 2)
                total = piece.last - piece.first
                spread = lambda x: pa.array(_at(x, full, total), mask=n == 0)
                lists = lambda x: _lists(x, full, total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[piece.first : piece.last], pa.array(n), spread(s1), spread(s2), lists(regions), lists(below), spread(packed[:, 0]), spread(packed[:, 1])],
                    ["doc", "n", "s1", "s2", "regions", "below", "k1", "k2"],
                )

    schema = "doc long, n long, s1 long, s2 long, regions array<long>, below array<long>, k1 long, k2 long"
    return docs.mapInArrow(each, schema)


def _at(values: np.ndarray, places: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros(total, np.int64)
    out[places] = values.view(np.int64) if values.flags.c_contiguous else np.ascontiguousarray(values).view(np.int64)
    return out


def _lists(values: np.ndarray, places: np.ndarray, total: int) -> pa.Array:
    n = np.zeros(total, np.int32)
    n[places] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                hashes, bounds = shingle_sets(piece, width)
                members = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[piece.first : piece.last], members], ["doc", "members"])

    return docs.mapInArrow(each, "doc long, members array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets share ``percent`` of their union."""
    side = lambda name: sets.select(F.col("doc").alias(name), F.col("members").alias(f"{name}_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both))
        .select("a", "b").distinct()
    )


def _close(left: str, right: str, percent: int) -> Column:
    """What sizes and sketches of a pair must fulfil to be similar."""
    bits = lambda k: F.bit_count(F.col(f"{left}{k}").bitwiseXOR(F.col(f"{right}{k}")))
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits("k1") + bits("k2") <= SKETCH_RADIUS)


def neighbours(rows: DataFrame, percent: int, region_rows: int) -> DataFrame:
    """Pairs next to each other in the sorted order of a region, and the heads of its pieces with its least document."""
    size = rows.groupBy("region").agg(F.count("*").alias("size"), F.min(F.struct("doc", "n", "k1", "k2")).alias("top"))
    large = F.col("size") > region_rows
    piece = F.when(large, F.xxhash64("below", F.pmod(F.xxhash64("doc"), F.ceil(F.col("size") / region_rows))))
    order = Window.partitionBy("region", "piece").orderBy("below", "doc")
    before = F.lag(F.struct("doc", "n", "k1", "k2")).over(order)
    out = rows.join(size, "region").withColumn("piece", piece).withColumn("near", F.coalesce(before, F.col("top")))
    out = out.select("doc", "n", "k1", "k2", *(F.col(f"near.{c}").alias(f"o_{c}") for c in ("doc", "n", "k1", "k2"))).where("doc != o_doc")
    return out.where(_close("", "o_", percent)).select(F.greatest("doc", "o_doc").alias("a"), F.least("doc", "o_doc").alias("b")).distinct()


def still_open(rows: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Rows of regions that hold several components, with the component of each row."""
    rows = rows.drop("component").join(known.withColumnRenamed("node", "doc"), "doc", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc"))
    open = rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region")
    return stage(rows.join(open, "region"), name)


def common_sizes(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """For each document of ``rows``, how many of its shingles any other of them holds: the most it can share."""
    docs = rows.select("doc").distinct()
    single = sets.join(docs, "doc", "left_semi").select("doc", F.explode("members").alias("m"))
    single = single.groupBy("m").agg(F.count("*").alias("docs"), F.min("doc").alias("doc")).where("docs = 1")
    own = single.groupBy("doc").agg(F.count("*").alias("own"))
    return docs.join(own, "doc", "left").select("doc", F.coalesce("own", F.lit(0)).alias("own"))


def across(rows: DataFrame, regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a region and lie in different components, each from its first common tree.

    A pair is compared inside the join and leaves it only if its sets, cut to
    32 bits a shingle, come within one percent of the bound. The cut can lose
    no shingle in common but two that fall together, hence the slack.
    """
    short = F.expr("transform(members, x -> cast((x & 4294967295L) - 2147483648L AS int))")
    rows = rows.join(regions, "doc").join(sets.select("doc", short.alias("short")), "doc")
    names = ("doc", "n", "k1", "k2", "component", "common", "tree", "regions", "short")
    left = rows.select("region", *(F.col(c).alias(f"l_{c}") for c in names))
    right = rows.select("region", *(F.col(c).alias(f"r_{c}") for c in names))
    most = F.least("l_common", "r_common")
    both = F.size(F.array_intersect("l_short", "r_short"))
    earlier = F.arrays_zip(F.slice("l_regions", 1, F.col("l_tree")).alias("l"), F.slice("r_regions", 1, F.col("l_tree")).alias("r"))
    cheap = (
        (F.col("l_component") < F.col("r_component"))
        & _close("l_", "r_", percent)
        & (100 * most >= percent * (F.col("l_n") + F.col("r_n") - most))
    )
    # The case keeps the order of the tests, and the one-element array computes the intersection once.
    once = F.get(F.transform(F.array(both), lambda x: 100 * x >= (percent - 1) * (F.col("l_n") + F.col("r_n") - x)), F.lit(0))
    alike = F.when(~cheap, False).when(F.exists(earlier, lambda x: x["l"] == x["r"]), False).otherwise(once)
    pairs = left.join(right, (left.region == right.region) & alike)
    return pairs.select(F.greatest("l_doc", "r_doc").alias("a"), F.least("l_doc", "r_doc").alias("b"))


def joined(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components after more links: the old ones are contracted first."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
    second = stage(components(ends.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")), name), name)
    moved = known.join(second.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return stage(moved.unionByName(second.join(known.select("node"), "node", "left_anti")), name)


def near_duplicates(
    df: DataFrame, text: str = "text", id: str = "doc_id", width: int = 5, percent: int = 80, region_rows: int = REGION_ROWS
) -> DataFrame:
    """Components of documents whose shingle sets share at least ``percent`` of their union.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``; a set holds the
    distinct runs of ``width`` words, or the whole sequence if shorter.
    Returns one row per input row: the id, ``n_shingles``, ``component_id``
    (smallest id reachable) and ``kept`` (the row with that id). Null and empty
    texts have no set and are linked with nothing. A row without id has no
    component and is kept. Rows that share an id follow their own sets. Other
    columns are not carried. ``percent`` below 80 would need more trees.
    """
    if percent < 80:
        raise ValueError("the number of trees is set for a similarity of 0.8 and more")
    docs = df.select(F.col(id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    signed = stage(signatures(docs, width), "signatures")
    classes = signed.where("n > 0 and doc is not null").groupBy("s1", "s2", "n").agg(
        F.min(F.struct("doc", "k1", "k2", "regions", "below")).alias("top")
    )
    nodes = stage(classes.select("s1", "s2", "n", "top.*"), "nodes")
    rows = nodes.select("doc", "n", "k1", "k2", "below", F.posexplode("regions").alias("tree", "region"))
    rows = rows.select("doc", "n", "k1", "k2", "tree", "region", F.get("below", F.col("tree")).alias("below"))
    shared = nodes.select(F.explode("regions").alias("region")).groupBy("region").count().where("count > 1").select("region")
    rows = stage(rows.join(shared, "region"), "regions")
    involved = rows.select("doc").distinct()
    sets = stage(sets_of(docs.join(involved, "doc", "left_semi"), width), "sets")
    links = stage(confirmed(neighbours(rows.where(F.col("tree") < FIRST_TREES), percent, region_rows), sets, percent), "links")
    known = stage(components(links, "first"), "first")
    rows = still_open(rows, known, "open")
    own = stage(common_sizes(sets, rows), "own")
    rows = rows.join(own, "doc").withColumn("common", F.col("n") - F.col("own")).where(100 * F.col("common") >= percent * F.col("n"))
    rows = still_open(rows, known, "open")
    links = stage(confirmed(neighbours(rows, percent, region_rows), sets, percent), "links")
    known = joined(known, links, "second")
    rows = still_open(rows, known, "open")
    links = stage(confirmed(across(rows, nodes.select("doc", "regions"), sets, percent), sets, percent), "links")
    final = joined(known, links, "final")
    member = nodes.select("s1", "s2", "n", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    member = member.select("s1", "s2", "n", F.coalesce("component", "doc").alias("component"))
    out = signed.select("doc", "n", "s1", "s2").join(member, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    out = out.select(F.col("doc").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
