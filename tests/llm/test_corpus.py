import random
import zlib

import brute
import pytest
from conftest import DOCUMENTS, rows

from panelkit.llm import decontamination, quality_classifier, queries, store

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def normal(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_matches(docs, items):
    from collections import Counter

    out = {}
    for d, t in docs:
        w = normal(t)
        for i, it in items:
            m = normal(it)
            if not m or not w:
                continue
            k, span = min(5, len(m)), min(len(m), len(w))
            cut = lambda x: Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            want, best = cut(m), None
            for s in range(len(w) - span + 1):
                have = cut(w[s : s + span])
                total = sum((have | want).values())
                score = sum((have & want).values()) / total
                if 100 * score >= 80 and (best is None or score > best[2]):
                    best = (s, span, score)
            if best:
                out[d, i] = best
    return out


@pytest.fixture(scope="module")
def world(write, corpus):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.choice([15, 30, 45, 59]))) for i in range(20)] + [(90, "tiny item"), (91, ""), (92, None), (93, " ... ")]
    texts = list(corpus)
    for i in range(30):
        own = items[i % 20][1].split(" ")
        for _ in range(i // 10):
            own[rnd.randrange(len(own))] = word()
        texts.append(text(40) + "\n" + ", ".join(own).upper() + ". " + text(rnd.randint(0, 30)))
    texts += ["Tiny, item!", items[3][1], items[4][1][: len(items[4][1]) * 9 // 10]]
    junk = [" ".join(word() + "***" for _ in range(40)) for _ in range(80)] + [text(40) for _ in range(240)]
    start = len(texts)
    texts += junk
    labels = [(i, int(i - start >= 80), 0) for i in range(start, len(texts))]
    return texts, items, labels, write(documents=(rows(texts), DOCUMENTS), benchmark=(items, ITEMS), labels=(labels, LABELS))


def test_leaks(spark, world):
    texts, items, _, sf = world
    out = {(r[0], r[1]): (r[2], r[3], pytest.approx(r[4])) for r in queries.op6_decontamination(spark, sf).collect()}
    want = brute_matches(list(enumerate(texts)), items)
    assert len(want) > 12 and want == out


def test_item_blocks(spark, world, monkeypatch):
    _, _, _, sf = world
    whole = sorted(map(tuple, queries.op6_decontamination(spark, sf).collect()))
    monkeypatch.setattr(decontamination, "ITEM_BYTES", 900)
    assert sorted(map(tuple, queries.op6_decontamination(spark, sf).collect())) == whole


def test_index_finds_all_within_the_radius():
    import numpy as np

    rnd = np.random.default_rng(1)
    prints = rnd.integers(0, 2**63, 50).astype(np.uint64)
    flips = [rnd.choice(64, k, replace=False) for k in range(0, 30) for _ in range(8)]
    asked = np.array([prints[n % 50] ^ np.uint64(sum(1 << int(b) for b in f)) for n, f in enumerate(flips)])
    got = set(zip(*(x.tolist() for x in decontamination.MultiIndex(prints).near(asked))))
    want = {(q, i) for q in range(len(asked)) for i in range(50) if int(asked[q] ^ prints[i]).bit_count() <= decontamination.RADIUS}
    assert got == want


def test_classifier(spark, world):
    texts, _, labels, sf = world
    out = {r.doc_id: r for r in queries.op2_quality_classifier(spark, sf).collect()}
    assert len(out) == len(texts)
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(d, q) for d, q, _ in labels if out[d].held_out]
    assert sum(out[d].predicted == q for d, q in held) >= 0.95 * len(held)


def test_scores_against_plain_ftrl(spark, world):
    """The update rule over dicts, one row after another, and the mean of the shards."""
    import math

    from pyspark.sql import functions as F

    q = quality_classifier
    _, _, _, sf = world
    docs, known = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    picked = q.sample(docs, known, "text", "doc_id", "quality", q.SAMPLE)
    picked = picked.select("*", F.xxhash64("id", F.lit(7)).alias("order"), F.pmod(F.xxhash64("id"), F.lit(q.SHARDS)).alias("shard"))
    shards = {}
    for r in sorted(picked.collect(), key=lambda r: (r.order, r.id)):
        shards.setdefault(r.shard, []).append(r)
    weigh = lambda z, n, l1, l2: 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((q.BETA + n**0.5) / q.ALPHA + l2)
    mean = {}
    for own in shards.values():
        z, n = {-1: 0.0}, {-1: 0.0}
        weight = lambda k: weigh(z.get(k, 0.0), n.get(k, 0.0), q.L1 * (k >= 0), q.L2 * (k >= 0))
        for _ in range(q.EPOCHS):
            for r in own:
                x = {-1: 1.0, **dict(zip(r.slots, r.vals))}
                w = {k: weight(k) for k in x}
                error = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - r.label
                for k, v in x.items():
                    g, before = error * v, n.get(k, 0.0)
                    z[k] = z.get(k, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / q.ALPHA * w[k]
                    n[k] = before + g * g
        for k in z:
            mean[k] = mean.get(k, 0.0) + weight(k) / len(shards)
    got = {r.doc_id: r.score for r in queries.op2_quality_classifier(spark, sf).collect()}
    every = q.sample(docs, docs.select("doc_id", F.lit(1).alias("quality")), "text", "doc_id", "quality", q.SAMPLE).collect()
    assert len(every) > 200
    for r in every:
        want = 1 / (1 + math.exp(-mean[-1] - sum(mean.get(k, 0.0) * v for k, v in zip(r.slots, r.vals))))
        assert got[r.id] == pytest.approx(want, abs=1e-4)


def test_classifier_never_sees_held_out_labels(spark, world, write):
    texts, _, labels, sf = world
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 0) for d, q, _ in labels]
    other = write(documents=(rows(texts), DOCUMENTS), labels=(flipped, LABELS))
    key = lambda sf: {r.doc_id: round(r.score, 9) for r in queries.op2_quality_classifier(spark, sf).collect()}
    assert key(sf) == key(other)


def test_pipeline(spark, world):
    import corpus_pipeline

    texts, items, labels, sf = world
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    left = {r.doc_id for r in queries.op2_quality_classifier(spark, sf).collect() if r.predicted}
    docs = [(d, t) for d, t in enumerate(texts) if d in left]
    found = brute.near_duplicates(docs, 5)
    docs = [(d, t) for d, t in docs if found[d][2]]
    leaks = {d for d, _ in brute_matches(docs, items)}
    assert set(out) == {d for d, _ in docs if d not in leaks}
    for d, r in out.items():
        if brute.secrets(texts[d])[:3] == (0, 0, 0) and "[secret]" not in (r.text or ""):
            assert r.text == (texts[d] or "")


@pytest.mark.parametrize("name", ["op2_quality_classifier", "op6_decontamination"])
def test_odd_tables(spark, write, name):
    labels, items = ([], LABELS), ([(1, "a b c d e f")], ITEMS)
    assert queries.QUERIES[name](spark, write(documents=([], DOCUMENTS), labels=labels, benchmark=([], ITEMS))).collect() == []
    same = [(None, "A b, c d e f g", None, None, None), (None, None, None, None, None), (1, "x", None, None, 1), (1, "x", None, None, 1)]
    labels = ([(1, None, 0), (2, 0, 0), (None, 1, 1)], LABELS)
    out = queries.QUERIES[name](spark, write(documents=(same, DOCUMENTS), labels=labels, benchmark=items)).collect()
    assert len(out) == (4 if name.startswith("op2") else 1)


def test_pipeline_decides_by_row(spark, write):
    """Null ids, repeated ids, repeated rows and an own column ``secrets``: only the judged row goes."""
    import corpus_pipeline

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    junk = lambda: " ".join(word() + "***" for _ in range(40))
    item, copy, twin, double = text(30), text(60), text(60), text(60)
    leak = lambda: text(20) + " " + item + " " + text(20)
    clean = [text(60) for _ in range(5)]
    odd = [
        (None, junk()), (None, leak()), (None, clean[0]), (None, copy), (None, copy), (None, twin), (9001, twin),
        (9002, junk()), (9002, clean[1]), (9003, leak()), (9003, clean[2]), (9004, double), (9004, double), (9005, double),
        (9006, copy), (9006, clean[3]), (9007, clean[4] + " token=abcdefgh"),
    ]
    known = [(i, junk() if i < 80 else text(40)) for i in range(320)]
    data = [(d, t, "en", "src", len(t), f"own {d}", f"key {d}") for d, t in odd + known]
    sf = write(
        documents=(data, DOCUMENTS + ", secrets string, row_key string"), benchmark=([(1, item)], ITEMS), labels=([(i, int(i >= 80), 0) for i, _ in known], LABELS)
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = store.stage(step(spark, docs, sf), "step")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "secrets", "row_key"]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.columns == [*docs.columns, "ids", "n_tokens"]
    assert last.drop("ids", "n_tokens").exceptAll(docs).count() == 0 == docs.count() - last.count()
    out = docs.collect()
    left = sorted(((r.doc_id, r.text) for r in out if r.doc_id is None or r.doc_id >= 9000), key=str)
    want = [(None, clean[0]), (9001, twin), (9002, clean[1]), (9003, clean[2]), (9004, double), (9006, copy), (9006, clean[3])]
    assert left == sorted([*want, (9007, clean[4] + " [secret]")], key=str)
    assert all((r.secrets, r.row_key) == (f"own {r.doc_id}", f"key {r.doc_id}") for r in out)
    assert next(r for r in out if r.doc_id == 9007).n_chars == len(clean[4] + " [secret]")


def test_pipeline_of_null_ids_and_no_rows(spark, write):
    import corpus_pipeline

    empty = write(documents=([], DOCUMENTS), benchmark=([], ITEMS), labels=([], LABELS))
    assert corpus_pipeline.run(spark, empty).collect() == []
    same = [(None, "one text of words", None, None, None)] * 3 + [(None, None, None, None, None)] * 2
    sf = write(documents=(same, DOCUMENTS), benchmark=([], ITEMS), labels=([], LABELS))
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, sf).collect()) == [(None, ""), (None, ""), (None, "one text of words")]
