"""Toxic spans by a linear-chain conditional random field over words.

Only documents carry labels, so the words are labelled first: a word, or a
beginning of words, is a sign of toxicity when it stands in many different
contexts of toxic documents and in hardly any of clean ones. Contexts are
neighbour pairs, so a thousand copies of a document count once. Stretches of labelled
words train a field of two tags by the gradient of its likelihood, the
expectations coming from the forward-backward recursion.

A document is scored by the same recursion over its whole text: the squares of
its words' marginal chances to be toxic are summed (squares, as the tiny
chances of very many clean words must not add up), the sum is mapped to a chance
by a logistic curve fitted on the training documents, and words that are
more likely toxic than not give the offending spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .store import stage

#: Labelled rows of each class that are learned from at most, picked by the hash of their id.
SAMPLE = 20_000
#: Labelled stretches that train the field, about as many with a toxic word as without, and their words.
STRETCHES = 40_000
STRETCH = 32
#: Words and beginnings looked at as signs, and taken as signs, at most: those of most toxic documents, the strongest.
CANDIDATES, SIGNS = 50_000, 5_000
#: A sign stands in so many toxic documents and in no more than this share of clean contexts.
LEAST_DOCUMENTS, MOST_CLEAN = 3, 0.1
#: Log-likelihood ratio that a sign reaches.
EVIDENCE = 20.0
#: Bytes of the beginnings of a word that are features beside the word.
BEGINNINGS = (4, 5, 6)
SHARDS = 4
#: Rarer features of a shard weigh nothing, so that what is unknown is judged by the bias.
LEAST_PLACES = 5
EPOCHS, BATCHES, RATE, RIDGE = 40, 8, 0.5, 1e-6
#: Features that the trained field keeps, the heaviest; slots of the table they are looked up in.
FEATURES, BITS = 100_000, 20
REMAINDER, MODULUS = 2, 4
#: Widest chain a step of the recursion takes at once.
CHUNK = 64

_KINDS = 1 + len(BEGINNINGS)


def held_out(id: str) -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % MODULUS == REMAINDER


def features(piece: grams.Piece) -> tuple[grams.Words, np.ndarray]:
    """Word spans and, for each word, the hashes of itself and of its beginnings, ASCII letters in lower case."""
    spans = grams.words(piece, grams.ALPHANUMERIC)
    sums = grams.prefix(grams.BYTE_VALUES[grams.LOWER[piece.data]])
    out = np.empty((_KINDS, len(spans)), np.uint64)
    for kind, most in enumerate((None, *BEGINNINGS)):
        ends = spans.ends if most is None else np.minimum(spans.ends, spans.starts + most)
        out[kind] = grams.slice_hash(sums, spans.starts, ends) + np.uint64(kind)
    return spans, out


def contexts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the neighbours of each word; at a text's ends they are missing."""
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:], after[:-1] = hashes[:-1], hashes[1:]
    edge = bounds[:-1][np.diff(bounds) > 0]
    before[edge] = 0
    after[bounds[1:][np.diff(bounds) > 0] - 1] = 0
    return grams.mix(before + np.uint64(0x9E3779B97F4A7C15)) ^ after


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def examples(df: DataFrame, labels: DataFrame, text: str, id: str, label: str, rows: int) -> DataFrame:
    """``id, label, text`` of at most ``rows`` labelled rows of each class outside the held-out part."""
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") > 0 if toxic else F.col("label") <= 0).orderBy(F.xxhash64("id"), "id").limit(rows) for toxic in (True, False)]
    picked = parts[0].unionByName(parts[1]).select("id", (F.col("label") > 0).cast("int").alias("label"))
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    # At most 2 x ``rows`` short rows: the broadcast's bound.
    return docs.join(F.broadcast(picked), "id").select("label", "text")


def _counted(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """``feature, n``: documents that hold each feature, or each wanted one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(0)):
                spans, hashes = features(piece)
                row = np.repeat(np.arange(len(spans.bounds) - 1), np.diff(spans.bounds))
                found = []
                for own in hashes:
                    ok = np.ones(len(own), bool) if wanted is None else np.isin(own, wanted)
                    pair = np.stack([own[ok], row[ok].astype(np.uint64)], axis=1)
                    found.append(np.unique(pair, axis=0)[:, 0] if len(pair) else own[:0])
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.array(n.astype(np.int64))], ["feature", "n"])

    return docs.select("text").mapInArrow(each, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().view(np.uint64)


def evidence(toxic: Column, clean: Column, share: float) -> Column:
    """Log-likelihood ratio of the two counts against a toxic share of ``share``."""
    total = toxic + clean
    part = lambda n, q: F.when(n > 0, n * F.log(n / (total * F.lit(q)))).otherwise(0.0)
    return 2 * (part(toxic, share) + part(clean, 1 - share))


def signs(docs: DataFrame) -> np.ndarray:
    """Hashes of the words and beginnings that tell toxic documents, sorted; at most ``SIGNS``."""
    counts = {r.label: r.n for r in docs.groupBy("label").agg(F.count("*").alias("n")).toLocalIterator()}
    if not counts.get(1) or not counts.get(0):
        return np.zeros(0, np.uint64)
    share = counts[1] / (counts[1] + counts[0])
    toxic = _counted(docs.where("label = 1"), None).where(F.col("n") >= LEAST_DOCUMENTS)
    first = toxic.orderBy(F.desc("n"), "feature").limit(CANDIDATES).toArrow()
    clean = _counted(docs.where("label = 0"), np.sort(_column(first, "feature"))).toArrow()
    # Both tables have at most ``CANDIDATES`` rows.
    at = np.argsort(_column(first, "feature"))
    key, n1 = _column(first, "feature")[at], first.column("n").to_numpy()[at]
    n0 = np.zeros(len(key))
    n0[np.searchsorted(key, _column(clean, "feature"))] = clean.column("n").to_numpy()
    own = n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        strength = 2 * (n1 * np.log(own / share) + np.where(n0 > 0, n0 * np.log((1 - own) / (1 - share)), 0))
    told = np.flatnonzero((own > share) & (strength >= EVIDENCE) & (1 - own <= MOST_CLEAN))
    told = np.sort(key[told[np.lexsort((key[told], -strength[told]))][:SIGNS]])
    if not len(told):
        return told

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for piece in grams.pieces(batch.column(0)):
                spans, hashes = features(piece)
                around = contexts(hashes[0], spans.bounds)
                row = np.repeat(np.arange(piece.first, piece.last), np.diff(spans.bounds))
                for own in hashes:
                    hit = np.flatnonzero(np.isin(own, told))
                    columns = [_signed(own[hit]), _signed(around[hit]), pa.array(labels[row[hit]].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["feature", "context", "label"])

    places = docs.select("text", "label").mapInArrow(each, "feature long, context long, label int").distinct()
    both = places.groupBy("feature").agg(F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    kept = both.where((F.col("clean") <= MOST_CLEAN * (F.col("toxic") + F.col("clean"))) & (evidence(F.col("toxic"), F.col("clean"), share) >= EVIDENCE))
    return np.sort(_column(kept.select("feature").toArrow(), "feature"))


def stretches(docs: DataFrame, told: np.ndarray) -> DataFrame:
    """Labelled stretches: features of each word and whether it is toxic; equal stretches once.

    Which ones are kept depends on their hash alone, so that about half of
    ``STRETCHES`` hold a toxic word, or all that there are.
    """

    def cut(batch: pa.RecordBatch, piece: grams.Piece):
        spans, hashes = features(piece)
        toxic = np.zeros(len(spans), bool)
        for own in hashes:
            toxic |= np.isin(own, told)
        rows = np.arange(piece.first, piece.last)
        toxic &= np.repeat(batch.column(1).to_numpy()[rows] > 0, np.diff(spans.bounds))
        size = np.diff(spans.bounds)
        n = -(-size // STRETCH)
        begin = np.repeat(spans.bounds[:-1], n) + STRETCH * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + STRETCH, np.repeat(spans.bounds[1:], n))
        marked = np.concatenate([[0], np.cumsum(toxic)])
        return hashes, toxic, begin, end, marked[end] > marked[begin]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for batch in batches:
            for piece in grams.pieces(batch.column(0)):
                n += np.bincount(cut(batch, piece)[4], minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array([False, True]), pa.array(n)], ["toxic", "n"])

    source = docs.select("text", "label")
    found = {r.toxic: r.n for r in source.mapInArrow(count, "toxic boolean, n long").groupBy("toxic").agg(F.sum("n").alias("n")).toLocalIterator()}
    share = np.array([min(1.0, STRETCHES / 2 / max(found.get(k, 0), 1)) for k in (False, True)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(0)):
                hashes, toxic, begin, end, kind = cut(batch, piece)
                sums = grams.prefix(hashes[0] ^ toxic.astype(np.uint64))
                own = grams.slice_hash(sums, begin, end)
                keep = np.flatnonzero((own >> np.uint64(11)).astype(np.float64) < share[kind.astype(int)] * 2.0**53)
                size = end[keep] - begin[keep]
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(offsets[-1]) + np.repeat(begin[keep] - offsets[:-1], size)
                flat = hashes[:, at].T.ravel()
                columns = [
                    _signed(own[keep]), pa.ListArray.from_arrays(pa.array((offsets * _KINDS).astype(np.int32)), _signed(np.ascontiguousarray(flat))),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(toxic[at].astype(np.int8))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "features", "tags"])

    return source.mapInArrow(each, "key long, features array<long>, tags array<tinyint>").dropDuplicates(["key"])


@dataclass
class Field:
    """A trained field. Scores are those of the toxic tag against the clean one."""

    slots: np.ndarray  # fingerprint of the feature in each slot
    weights: np.ndarray
    bias: float
    start: float
    enter: float  # clean to toxic
    leave: float  # toxic to clean
    stay: float  # toxic to toxic; clean to clean is 0

    def emissions(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape[1], self.bias)
        for own in hashes:
            at = (own >> np.uint64(64 - BITS)).astype(np.int64)
            out += np.where(self.slots[at] == own, self.weights[at], 0.0)
        return out


def field(keys: np.ndarray, weights: np.ndarray, bias: float, start: float, enter: float, leave: float, stay: float) -> Field:
    """The field as a lookup table of its ``FEATURES`` heaviest features; in a shared slot the heavier one stays."""
    order = np.lexsort((keys, np.abs(weights)))[-FEATURES:]
    keys, weights = keys[order], weights[order]
    slots, table = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS)
    at = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    slots[at], table[at] = keys, weights
    return Field(slots, table, bias, start, enter, leave, stay)


def _forward_backward(u: np.ndarray, length: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches side by side: chances of the toxic tag, and of each change of tags, in sum.

    ``u`` holds an emission score a word and row, ``model`` the scores of
    start, enter, leave and stay. Odds of toxic to clean are carried forward and back.
    """
    start, enter, leave, stay = np.exp(model)
    e = np.exp(np.clip(u, -30, 30))
    n = u.shape[1]
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = start * e[:, 0]
    for t in range(1, n):
        ahead[:, t] = e[:, t] * (enter + stay * ahead[:, t - 1]) / (1 + leave * ahead[:, t - 1])
    for t in range(n - 2, -1, -1):
        next = e[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(t + 1 < length, (leave + stay * next) / (1 + enter * next), 1.0)
    odds = ahead * back
    chance = odds / (1 + odds)
    # Pairs of neighbours: clean-clean 1, clean-toxic, toxic-clean, toxic-toxic, over their sum.
    next = e[:, 1:] * back[:, 1:]
    r = ahead[:, :-1]
    pairs = np.stack([enter * next, r * leave, r * stay * next])
    return chance, pairs / (1 + pairs.sum(axis=0))


def _trained(table: pa.Table) -> pa.Table:
    """Weights of one shard by adaptive gradient steps on the likelihood of its stretches."""
    table = table.sort_by("key")
    tags = [np.asarray(x) for x in table.column("tags").to_numpy(zero_copy_only=False)]
    lists = table.column("features").combine_chunks().flatten().to_numpy().view(np.uint64)
    keys, slot, places = np.unique(lists, return_inverse=True, return_counts=True)
    common = places >= LEAST_PLACES
    keys, slot = keys[common], np.where(common, np.cumsum(common) - 1, common.sum())[slot]
    size = np.array([len(t) for t in tags])
    begin = np.cumsum(size) - size
    y = np.concatenate(tags).astype(np.float64)
    slot = slot.reshape(-1, _KINDS)
    # The last weight stands for all rare features and stays 0.
    weights, chain = np.zeros(len(keys) + 1), np.array([-2.0, -2.0, 0.0, 0.0])
    bias, step, chain_step, bias_step = -2.0, np.full(len(keys), 1e-8), np.full(4, 1e-8), 1e-8
    order = np.random.default_rng(5).permutation(len(size))
    for epoch in range(EPOCHS):
        for part in np.array_split(order, BATCHES):
            if not len(part):
                continue
            length = size[part]
            column = np.arange(STRETCH)
            real = column < length[:, None]
            at = begin[part][:, None] + np.minimum(column, length[:, None] - 1)
            own = slot[at]
            u = np.where(real, bias + weights[own].sum(axis=2), -30.0)
            want = np.where(real, y[at], 0.0)
            chance, pairs = _forward_backward(u, length, chain)
            gap = np.where(real, want - chance, 0.0)
            both = real[:, 1:]
            seen = [(1 - want[:, :-1]) * want[:, 1:], want[:, :-1] * (1 - want[:, 1:]), want[:, :-1] * want[:, 1:]]
            turn = np.array([gap[:, 0].sum(), *(((s - p) * both).sum() for s, p in zip(seen, pairs))])
            g = np.bincount(own.ravel(), weights=np.repeat(gap.ravel(), _KINDS), minlength=len(weights))[:-1] - RIDGE * len(part) * weights[:-1]
            step += g * g
            weights[:-1] += RATE * g / np.sqrt(step)
            chain_step += turn * turn
            chain += RATE * turn / np.sqrt(chain_step)
            bias_step += gap.sum() ** 2
            bias += RATE * gap.sum() / bias_step**0.5
    used = np.flatnonzero(weights)
    rest = [bias, *chain]
    return pa.table({
        "kind": pa.array(np.concatenate([np.arange(1, 6), np.zeros(len(used))]).astype(np.int32)),
        "feature": _signed(np.concatenate([np.zeros(5, np.uint64), keys[used]])), "weight": np.concatenate([rest, weights[used]]),
    })


def train(windows: DataFrame, shards: int = SHARDS) -> Field:
    """The mean of the fields of ``shards`` parts of the stretches; without stretches nothing is toxic."""
    dealt = windows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    parts = stage(dealt.groupBy("shard").applyInArrow(_trained, "kind int, feature long, weight double"), "field")
    n = parts.where("kind = 1").count()
    if not n:
        return field(np.zeros(0, np.uint64), np.zeros(0), -30.0, -5.0, -5.0, 0.0, 0.0)
    # A feature counts by the shards that have seen it.
    means = parts.groupBy("kind", "feature").agg(F.avg("weight").alias("weight"))
    rest = {r.kind: r.weight for r in means.where("kind > 0").toLocalIterator()}
    heavy = means.where("kind = 0").orderBy(F.desc(F.abs("weight")), "feature").limit(FEATURES).toArrow()
    return field(_column(heavy, "feature"), heavy.column("weight").to_numpy(), *(rest[k] for k in range(1, 6)))


def marginals(u: np.ndarray, bounds: np.ndarray, model: Field) -> np.ndarray:
    """Chance of the toxic tag for each word of all texts, by the exact recursion over each whole text.

    The recursion is linear in the pair of forward (backward) sums, so chains
    are cut into chunks: a product of 2 x 2 matrices a chunk, all chunks side by
    side; the chunks' products one after another; then all chunks again from
    their true beginnings. At a text's first word the matrix forgets what was before.
    """
    n = len(u)
    if not n:
        return np.zeros(0)
    start, enter, leave, stay = np.exp([model.start, model.enter, model.leave, model.stay])
    width = -(-n // CHUNK) * CHUNK
    e = np.ones(width)
    e[:n] = np.exp(np.clip(u, -30, 30))
    first = np.zeros(width + 1, bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    first[n:] = True
    # Forward: clean' = a clean + b toxic, toxic' = c clean + d toxic.
    at = first[:width]
    forward = [np.ones(width), np.where(at, 1.0, leave), np.where(at, start, enter) * e, np.where(at, start, stay) * e]
    ahead = _chain(forward, True)
    # Backward, from word t + 1 to word t: the next word's emission counts; at a text's last word nothing does.
    next = np.concatenate([e[1:], [1.0]])
    at = first[1:]
    backward = [np.ones(width), np.where(at, 0.0, enter * next), np.where(at, 1.0, leave), np.where(at, 0.0, stay * next)]
    back = _chain(backward, False)
    odds = ahead * back
    return (odds / (1 + odds))[:n]


def _chain(m: list[np.ndarray], forward: bool) -> np.ndarray:
    """Odds after each matrix of a long product, from odds of one, in the given direction."""
    a, b, c, d = (x.reshape(-1, CHUNK) for x in m)
    steps = range(CHUNK) if forward else range(CHUNK - 1, -1, -1)
    p = [np.ones(len(a)), np.zeros(len(a)), np.zeros(len(a)), np.ones(len(a))]
    for t in steps:
        p = [a[:, t] * p[0] + b[:, t] * p[2], a[:, t] * p[1] + b[:, t] * p[3], c[:, t] * p[0] + d[:, t] * p[2], c[:, t] * p[1] + d[:, t] * p[3]]
        top = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        p = [x / top for x in p]
    odds, begin = 1.0, np.empty(len(a))
    product = [x.tolist() for x in p]
    for k in range(len(a)) if forward else range(len(a) - 1, -1, -1):
        begin[k] = odds
        odds = (product[2][k] + product[3][k] * odds) / (product[0][k] + product[1][k] * odds)
    out = np.empty_like(a)
    for t in steps:
        begin = (c[:, t] + d[:, t] * begin) / (a[:, t] + b[:, t] * begin)
        out[:, t] = begin
    return out.ravel()


def tag(df: DataFrame, model: Field, text: str, id: str) -> DataFrame:
    """``id, weight, spans``: the sum of squared chances, and code points of the stretches of words likelier toxic than not."""
    names = ["id", "weight", "spans"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in grams.pieces(batch.column(1)):
                spans, hashes = features(piece)
                chance = marginals(model.emissions(hashes), spans.bounds, model)
                total = np.concatenate([[0.0], np.cumsum(chance * chance)])
                weight = total[spans.bounds[1:]] - total[spans.bounds[:-1]]
                hit = chance > 0.5
                row = np.repeat(np.arange(len(weight)), np.diff(spans.bounds))
                same = np.concatenate([[False], hit[1:] & hit[:-1] & (row[1:] == row[:-1])])
                begin = np.flatnonzero(hit & ~same)
                end = np.flatnonzero(hit & ~np.concatenate([same[1:], [False]])[: len(hit)])
                chars = np.concatenate([[0], np.cumsum((piece.data & 0xC0) != 0x80)])
                base = chars[piece.offsets[row[begin]]]
                items = [chars[spans.starts[begin]] - base, chars[spans.ends[end]] - base]
                struct = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in items], ["start", "end"])
                offsets = pa.array(np.searchsorted(row[begin], np.arange(len(weight) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[piece.first : piece.last], pa.array(weight), pa.ListArray.from_arrays(offsets, struct)], names)

    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(each, f"id {kind}, weight double, spans array<struct<start:long,end:long>>")


def _curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through ``(x, clean, toxic)``, with a light ridge on the slope."""
    if not points:
        return 1.0, 0.0
    x, clean, toxic = (np.array(v, np.float64) for v in zip(*points))
    beta = np.array([1.0, 0.0])
    total = clean + toxic
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta[0] * x + beta[1], -30, 30)))
        g = np.array([((toxic - total * p) * x).sum() - (beta[0] - 1), (toxic - total * p).sum() - 1e-3 * beta[1]])
        w = total * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        beta = beta + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(beta[0], 0.0)), float(beta[1])


def _evidence_of(weight: Column) -> Column:
    return F.log(weight + F.lit(1e-6))


def classify(
    df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", threshold: float = 0.3, rows: int = SAMPLE,
) -> DataFrame:
    """``id, held_out, score, predicted, spans`` of every row, trained on ``labels``.

    Learned from are at most ``rows`` rows of each class and at most about
    ``STRETCHES`` stretches of them; rows whose id has a crc32 of remainder
    ``REMAINDER`` by ``MODULUS`` never. Only the text enters a score. Null and
    empty texts have no words and get the curve's lowest score. A null id is not held out.
    Repeated ids are scored each by its own text; of several labels of an id
    the highest counts. Without labels of both classes no word is toxic and
    every score is that of the curve through the labels there are, 0.5 at most.
    ``spans`` are ``start, end`` in code points. Other columns are not carried.
    """
    docs = stage(examples(df, labels, text, id, label, rows), "examples")
    told = signs(docs)
    model = train(stage(stretches(docs, told), "stretches") if len(told) else docs.sparkSession.createDataFrame([], "key long, features array<long>, tags array<tinyint>"))
    seen = tag(docs, model, "text", "label").select(F.round(_evidence_of(F.col("weight")), 1).alias("x"), F.col("id").alias("label"))
    # Logarithms to one place: at most a few hundred rows.
    points = list(seen.groupBy("x").agg(F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")).toLocalIterator())
    slope, intercept = _curve([(r.x, r.clean, r.toxic) for r in points])
    if not len(told):
        slope, intercept = 0.0, min(0.0, intercept)
    score = 1 / (1 + F.exp(-(F.lit(slope) * _evidence_of(F.col("weight")) + F.lit(intercept))))
    out = tag(df, model, text, id).withColumn("score", score)
    return out.select(F.col("id").alias(id), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
