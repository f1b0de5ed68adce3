import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import DOCUMENTS, rows

from panelkit.llm import grams, periodic_runs, ptolemaic_clusters, queries


def brute_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p) and j > i:
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def structured(rnd):
    k = rnd.choice([1, 2, 3, 6])
    base = [rnd.randrange(k) for _ in range(rnd.choice([1, 2, 3, 7, 20, 50]))]
    if rnd.random() < 0.15:
        a, b = [0], [0, 1]
        while len(b) < 600:
            a, b = b, b + a
        return b
    w = []
    while len(w) < 500:
        m = rnd.randrange(5)
        if m == 0:
            w += base * rnd.randrange(1, 60)
        elif m == 1:
            w += base[: rnd.randrange(len(base) + 1)]
        elif m == 2 and w:
            w += w[-rnd.randrange(1, len(w) + 1) :]
        elif m == 3:
            w += [rnd.randrange(9)]
        else:
            w += [base[0]] * rnd.randrange(40)
    return w[:1200]


def found(docs):
    w = np.array(sum(docs, []), np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    r = periodic_runs.find(w, bounds)
    return sorted(zip(r.start.tolist(), r.length.tolist(), r.period.tolist())), bounds


def test_runs_of_structured_texts():
    rnd = random.Random(3)
    long = 0
    for _ in range(60):
        docs = [structured(rnd), [], structured(rnd), [rnd.randrange(2) for _ in range(300)]]
        got, bounds = found(docs)
        want = sorted((s + int(bounds[k]), n, p) for k, d in enumerate(docs) for s, n, p in brute_runs(d))
        assert got == want
        long += sum(p >= periodic_runs.DIRECT for *_, p in want)
    assert long > 300


def test_two_short_runs_that_meet_make_longer_ones():
    # One period is a stretch of "0 1", and so is the next: no gram outside a short run in the first.
    docs = [[0, 1] * 50 + [0] + [0, 1] * 60, [0, 1, 2] * 40 + [1, 2] + [0, 1, 2] * 40]
    got, bounds = found(docs)
    assert got == sorted((s + int(bounds[k]), n, p) for k, d in enumerate(docs) for s, n, p in brute_runs(d))
    assert max(p for *_, p in got) > 90


def test_one_very_long_text():
    word = [str(i) for i in range(1000)]
    text = " ".join(["same"] * 300_000 + word * 40 + ["a", "b"] * 100_000)
    piece = next(grams.pieces(__import__("pyarrow").array([text])))
    spans = grams.words(piece)
    r = periodic_runs.find(periodic_runs.word_numbers(piece, spans), spans.bounds)
    assert list(zip(r.start.tolist(), r.length.tolist(), r.period.tolist())) == [(0, 300_000, 1), (300_000, 40_000, 1000), (340_000, 200_000, 2)]


def brute_document(id, text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    runs.sort(key=lambda r: (r[0], r[2]))
    return (
        id, len(runs), *(best[i] if best else None for i in range(3)), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_op12_against_brute_force(spark, write, corpus):
    rnd = random.Random(8)
    texts = [*corpus, *(" ".join(f"w{x}" for x in structured(rnd)[:400]) for _ in range(60)), None, "", " ", "x"]
    sf = write(documents=(rows(texts), DOCUMENTS))
    got = queries.QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(brute_document(i, t) for i, t in enumerate(texts))
    assert sum(r.n_runs > 0 for r in got) > 60


def test_op12_odd_rows(spark):
    text = "a b " * 10
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, text, 6), (2, None, 7)], "doc_id long, text string, runs int")
    out = periodic_runs.runs(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_words, len(r.runs), r.collapsed) for r in out if r.doc_id) == [
        (False, 1, 20, 1, "a b"), (False, 1, 20, 1, "a b"), (False, 2, 0, 0, ""),
    ]
    assert [r.collapsed for r in out if r.doc_id is None] == ["a b"]
    assert periodic_runs.runs(docs.limit(0)).collect() == []


def brute_clusters(vectors, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted((r for r in kept if r[0] is not None), key=key)[:k]]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        own = [min((gap(x, c), j) for j, c in enumerate(cents)) for _, x in kept]
        if r == rounds:
            break
        for j in range(len(cents)):
            mine = [x for (_, x), (_, n) in zip(kept, own) if n == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    sums = {j: sum(d for d, n in own if n == j) for _, j in own}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted((i, n, d, sums[n], sum(sums.values()), sha(cents[n])) for (i, _), (d, n) in zip(kept, own))


EMBEDDINGS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("kind", ["spread", "few values", "copies", "few", "large"])
def test_op11_against_brute_force(spark, write, kind):
    rnd = random.Random(4)
    one = {
        "spread": lambda: [rnd.gauss(0, 1) for _ in range(64)],
        "few values": lambda: [rnd.choice([0.0, 1 / 64]) if i < 3 else 0.5 for i in range(64)],
        "copies": lambda: [0.25] * 64,
        "few": lambda: [rnd.gauss(0, 1) for _ in range(64)],
        "large": lambda: [float(1 << 22) + rnd.randrange(9), *(rnd.choice([-1.0, 1.0]) * rnd.randrange(1 << 9) for _ in range(63))],
    }[kind]
    data = [(i % 170, one(), 0) for i in range(7 if kind == "few" else 200)]
    data += [(900, [0.0] * 63, 0), (901, None, 0), (902, [0.0] * 63 + [None], 0), (903, [0.0] * 63 + [math.inf], 0), (904, [math.nan] * 64, 0), (905, [], 0)]
    sf = write(embeddings=(data, EMBEDDINGS))
    got = queries.QUERIES["op11_ptolemaic_clusters"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute_clusters([r[:2] for r in data])


def test_op11_odd_tables(spark, write):
    sf = write(embeddings=([(1, [0.0] * 3, 0)], EMBEDDINGS))
    assert queries.QUERIES["op11_ptolemaic_clusters"](spark, sf).collect() == []
    df = spark.createDataFrame([(None, [1.0] * 64, 2, 3), (7, [2.0] * 64, 2, 3)], "vec_id long, embedding array<double>, cluster int, x int")
    out = ptolemaic_clusters.cluster(df).collect()
    assert sorted((r.cluster, r.vec_id, r.distance) for r in out) == [(0, 7, 0), (1, None, 0)]


def test_bounds_never_exceed_the_distance():
    rnd = np.random.default_rng(2)
    for scale in (1, 3, 1 << 20):
        x, c = (rnd.integers(-scale, scale + 1, (300, 64)) for _ in range(2))
        pivots = ptolemaic_clusters.choose_pairs(c[:16])
        low = ptolemaic_clusters.lower_bounds(pivots, pivots.distances(x), pivots.distances(c))
        true = np.array([ptolemaic_clusters._squares(x, y[None, :]) for y in c]).T
        assert (low <= true).all()
        assert np.allclose(low[:, :16], true[:, :16])  # a pivot's own bound is its distance


def test_bounds_spare_distances():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-200, 200, (16, 64))
    x = centres[rnd.integers(0, 16, 2000)] + rnd.integers(-9, 10, (2000, 64))
    pivots = ptolemaic_clusters.choose_pairs(x[:16])
    done = ptolemaic_clusters.nearest(pivots, x, pivots.distances(x), centres)[2]
    assert done < 4 * len(x)
