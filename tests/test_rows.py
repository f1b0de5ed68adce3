"""Samples, text rows, pairs, prompts, vocabularies and vectors."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.functions import arrays
from panelkit.operators import sampling, textrows, vectors, vocab
from panelkit.plans import jobs


@pytest.fixture(scope="module")
def panel_cells(spark):
    rng = random.Random(2)
    names = [f"{h}{w}x" for w in range(1, 6) for h in ("cm", "cf", "m", "f", "k")]
    rows = [
        (i, o, n, float(rng.randrange(-1, 4)))
        for i in range(60) for o, n in enumerate(names) if rng.random() < 0.7
    ]
    return rows, spark.createDataFrame(rows, "id long, ord int, feature string, value double").cache()


def test_feature_subsets(spark, panel_cells):
    rows, df = panel_cells
    have = {}
    for i, o, n, v in rows:
        if v >= 0:
            have.setdefault(i, {})[n] = (o, v)
    got = sampling.feature_subsets(df, "id", 8, 6, 9, seed=1).collect()
    again = sampling.feature_subsets(df.repartition(5), "id", 8, 6, 9, seed=1).collect()

    def flat(out):
        return sorted((r.id, r.sample_no, [c.feature for c in r.cells]) for r in out)

    assert flat(got) == flat(again) and len(got) == 8 * len(have)
    sizes = Counter()
    for r in got:
        mine = have[r.id]
        con = [c for c in r.cells if c.feature[:2] in ("cm", "cf")]
        n_con = sum(n[:2] in ("cm", "cf") for n in mine)
        names = [c.feature for c in r.cells]
        assert len(set(names)) == len(names) <= 9
        assert [mine[n] for n in names] == sorted((c.ord, c.value) for c in r.cells)
        assert len(con) == min(-(-max(len(names), 6) // 3), n_con) or len(con) <= n_con
        sizes[len(names)] += 1
    assert set(sizes) >= {6, 7, 8, 9}


def test_corpus_lines(panel_cells):
    _, df = panel_cells
    lines = jobs.sampled_corpus(df, "id", 2, 3, 3, seed=4).collect()
    assert all(len(r.text.split()) == 6 and r.text.endswith(" ") for r in lines)


def test_sampling_k(spark):
    rows = [(i, r, float(r)) for i in range(5) for r in range(400 if i == 0 else 12)]
    df = spark.createDataFrame(rows, "id long, r long, v double")
    a = sampling.sample_k_per_id(df, "id", ["r"], 10, 1).collect()
    b = sampling.sample_k_per_id(df.repartition(6), "id", ["r"], 10, 1).collect()
    assert sorted(a) == sorted(b) and Counter(r.id for r in a) == {i: 10 for i in range(5)}
    with pytest.raises(Exception, match="fewer than 13"):
        sampling.sample_k_per_id(df, "id", ["r"], 13, 1).collect()
    assert sampling.short_ids(df, "id", 13).count() == 4
    with pytest.raises(Exception, match="too few rows"):
        sampling.k_means_per_id(df, "id", ["r"], "v", [1, 13], 1).collect()
    means = {(r.k, r.id): r.predicted_diff for r in sampling.k_means_per_id(df, "id", ["r"], "v", [1, 10], 1).collect()}
    for i in range(5):
        picked = [r.v for r in a if r.id == i]
        assert means[10, i] == pytest.approx(np.mean(picked))
        assert means[1, i] == next(r.v for r in a if r.id == i and r["rank"] == 1)


def test_splits(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("g"), "id")
    by_id = sampling.hash_split(df, ["g"], 0.1, 3)
    sides = by_id.groupBy("g").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    assert 0.06 < by_id.where("split = 'test'").count() / 4000 < 0.14
    ordered = sampling.ordered_split(df, "g", 0.9)
    assert {r.g for r in ordered.where("split = 'train'").collect()} == set(range(360))
    assert sampling.bernoulli(df, ["id"], 1.0, 1).count() == 4000


def test_same_and_mixed_samples(spark):
    rng = np.random.default_rng(1)
    rows = [(g, g * 1000 + i, rng.normal(size=4).tolist()) for g in range(30) for i in range(20 + g)]
    df = spark.createDataFrame(rows, "g long, r long, v array<double>").cache()
    same = sampling.same_id_samples(df, "g", "r", 8, 3, 1).collect()
    groups: dict = {}
    for r in same:
        groups.setdefault((r.g, r.repeat), []).append(r.r)
        assert r.r // 1000 == r.g
    assert len(groups) == 90 and all(len(set(x)) == len(x) == 8 for x in groups.values())
    for n in (5, 20):  # draws in turn, and all ids in hash order
        mixed: dict = {}
        for r in sampling.mixed_id_samples(df, "g", "r", n, 3, 1).collect():
            mixed.setdefault(r.sample_no, []).append((r.g, r.r))
        assert set(mixed) == set(range(1, 91))
        assert all(len({g for g, _ in x}) == len(x) == n and all(r // 1000 == g for g, r in x) for x in mixed.values())
    with pytest.raises(Exception, match="cannot draw 21 rows"):
        sampling.same_id_samples(df, "g", "r", 21, 1, 1).collect()
    vec = {r: v for _, r, v in rows}
    samples = sampling.same_id_samples(df, "g", "r", 8, 3, 1)
    for d in sampling.sample_dispersion(samples, ["g", "repeat"], df, "r", "v", 4).collect():
        m = np.array([vec[r] for r in groups[d.g, d.repeat]])
        assert d.dispersion == pytest.approx(np.linalg.norm(m - m.mean(0), axis=1).mean())


def test_dispersion_and_pooling(spark):
    rng = np.random.default_rng(2)
    rows = [(0 if i % 3 == 0 else i % 7, rng.normal(size=5).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, v array<double>")
    for r in vectors.centroid_dispersion(df, ["g"], "v").collect():
        m = np.array([v for g, v in rows if g == r.g])
        assert r.n_rows == len(m)
        assert r.dispersion == pytest.approx(np.linalg.norm(m - m.mean(0), axis=1).mean())
    tokens = [(1, [[1.0, 2.0], [3.0, 6.0]], [1, 0]), (1, [[5.0, 0.0], [7.0, 2.0]], [1, 1])]
    t = spark.createDataFrame(tokens, "g long, t array<array<double>>, m array<int>")
    assert vectors.mean_pool(t, ["g"], "t").first()["embedding"] == [4.0, 2.5]
    assert vectors.mean_pool(t, ["g"], "t", "m").first()["embedding"] == [3.5, 1.5]
    dist = df.select(arrays.l2_distance(F.col("v"), F.col("v"))).distinct().collect()
    assert [r[0] for r in dist] == [0.0]


def test_matrix_blocks(spark):
    rows = [(0 if i % 3 == 0 else i, i, [i, i + 1], f"l{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "g long, r long, ids array<int>, label string").repartition(4)
    blocks = vectors.matrix_blocks(df, "g", "r", "ids", "label", block_rows=8).collect()
    hot = sorted((b.block_no, b.matrix, b.label, b.n_rows) for b in blocks if b.g == 0)
    want = [list(x[2]) for x in rows if x[0] == 0]
    assert [m for _, part, _, _ in hot for m in part] == want
    assert {b[2] for b in hot} == {"l0"} and max(b[3] for b in hot) == 8
    assert len(blocks) == 60 + len(hot)


def test_histogram(spark):
    df = spark.createDataFrame([(0.05,), (0.14,), (0.16,), (0.1,)], "v double")
    got = {r.bin: r.n for r in vectors.histogram(df, "v", 0.1).collect()}
    assert got == {0: 1, 1: 3}


def test_render_rows(spark):
    df = spark.createDataFrame([(1, "b1", 2.9), (1, "a1", 0.0), (2, "a1", 7.0), (2, "zz", 1.0)], "id long, feature string, value double")
    listed = ["a1", "b1", "c1"]

    def texts(style):
        return {r.id: r.text for r in textrows.render_rows(df, "id", listed, style).collect()}

    assert texts("plain") == {1: "a1 0 b1 2 ", 2: "a1 7 "}
    assert texts("comma") == {1: "a1 0 , b1 2 , ", 2: "a1 7 , "}
    assert texts("raw") == {1: "a1 0.0 , b1 2.9 , c1 nan , ", 2: "a1 7.0 , b1 nan , c1 nan , "}
    assert texts("token") == {1: "a1_0 b1_2 c1_# ", 2: "a1_7 b1_# c1_# "}
    chunks = spark.createDataFrame([(0, ["b1", "a1"]), (1, ["a1", "c1"])], "chunk_index long, chunk array<string>")
    got = {(r.chunk_index, r.id): r.text for r in textrows.render_chunks(df, "id", chunks, min_rows=None).collect()}
    assert got == {(0, 1): "b1 2 , a1 0 , ", (0, 2): "a1 7 , ", (1, 1): "a1 0 , ", (1, 2): "a1 7 , "}
    assert textrows.render_chunks(df, "id", chunks, min_rows=3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 41, 200])
def test_pairs(spark, n):
    rng = random.Random(n)
    rows = [(i, f"t{i}", rng.randrange(6)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, t string, y long")
    got = textrows.pair_rows(df, "k", "t", "y", 42).orderBy("pair_no").collect()
    import hashlib

    order = sorted(rows, key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
    want = []
    for a, b in zip(order[::2], order[1::2]):
        if a[2] == b[2]:
            continue
        short, long_ = sorted([a, b], key=lambda r: r[2])
        label = len(want) % 2
        first, second = (short, long_) if label == 0 else (long_, short)
        want.append((len(want) + 1, label, long_[2] - short[2], f"Person 0: {first[1]}\nPerson 1: {second[1]}"))
    assert [(r.pair_no, r.label, r.diff, r.pair_texts) for r in got] == want


def test_prompt_ends_at_first_failure(spark):
    rows = [(i, "w " * n, 10 + i) for i, n in enumerate([5, 4, 60, 1, 1])]
    df = spark.createDataFrame(rows, "k long, t string, y long")
    got = [r.k for r in textrows.pack_prompt(df, "k", "t", "y", 20).orderBy("k").collect()]
    assert got == [0, 1]
    assert textrows.pack_prompt(df, "k", "t", "y", 1000).count() == 5
    first = textrows.pack_prompt(df, "k", "t", "y", 20).orderBy("k").first()
    assert first.prompt == "w " * 5 + "\nlife span: 10\n\n"


def test_labelled_texts(spark):
    schema = "rec_id long, input_text struct<table:struct<column_header:array<string>,content:array<string>>>, target_text string"
    rows = [
        (1, ((["name", "death_date"], ["aged 5", "may 1900 aged 71"]),), "born 1829"),
        (2, ((["death_date"], ["aged"]),), "x"),
        (3, ((["death_date", "death_date"], ["aged ten", "aged 12 aged 13"]),), "y 1"),
        (4, ((["birth"], ["aged 4"]),), "z"),
    ]
    got = textrows.labelled_texts(spark.createDataFrame(rows, schema)).orderBy("rec_id").collect()
    assert [(r.rec_id, r.label, r.masked_text) for r in got] == [(1, 71.0, "born *"), (3, 12.0, "y *")]


def test_authors(spark):
    papers = spark.createDataFrame([([["A", "b"], ["C", ""]],), ([["A", "b"]],), ([],)], "authors_parsed array<array<string>>")
    counts = textrows.author_frequency(papers)
    assert {r.author: r.n_papers for r in counts.collect()} == {"A b": 2, "C ": 1}
    assert {r.n_papers: r.n_authors for r in textrows.frequency_of_frequency(counts).collect()} == {1: 1, 2: 1}


def test_author_rows_hold_one_text(spark):
    papers = spark.createDataFrame([("s", [["A", "b"], None]), ("u", [["A", "b"]]), (None, None)], "source string, authors_parsed array<array<string>>")
    counts = textrows.author_frequency(papers, by=["source"])
    assert {(r.source, r.author): r.n_papers for r in counts.collect()} == {("s", "A b"): 1, ("s", None): 1, ("u", "A b"): 1}
    # The names are joined before the list is taken apart.
    assert "explode(transform(authors_parsed" in counts._jdf.queryExecution().analyzed().toString()


def test_vocab_and_encoding_match_tokenizers(spark):
    tok = pytest.importorskip("tokenizers")
    rng = random.Random(6)
    lines = ["".join(f"f{rng.randrange(40)}_{rng.randrange(3)} " for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    words = vocab.top_vocab(vocab.token_counts(df), 60)
    model = tok.Tokenizer(tok.models.WordLevel(unk_token="[UNK]"))
    model.pre_tokenizer = tok.pre_tokenizers.CharDelimiterSplit(" ")
    model.train_from_iterator(lines, tok.trainers.WordLevelTrainer(vocab_size=60, special_tokens=list(vocab.SPECIAL_TOKENS)))
    assert {r.token: r.id for r in words.collect()} == model.get_vocab()
    model.post_processor = tok.processors.TemplateProcessing(single="[CLS] $A [SEP]", special_tokens=[("[CLS]", 2), ("[SEP]", 3)])
    model.enable_truncation(16)
    model.enable_padding(pad_id=1, pad_token="[PAD]", length=16)
    encoded = {r.id: r for r in vocab.encode(df, ["id"], words, 16).collect()}
    for i, line in enumerate(lines):
        e = model.encode(line)
        assert encoded[i].input_ids == e.ids
        assert encoded[i].attention_mask == e.attention_mask
        assert encoded[i].special_tokens_mask == e.special_tokens_mask


def test_empty_text_is_only_specials(spark):
    df = spark.createDataFrame([(1, ""), (2, "a ")], "id long, text string")
    words = vocab.top_vocab(vocab.token_counts(df), 10)
    got = {r.id: r.input_ids for r in vocab.encode(df, ["id"], words, 4).collect()}
    assert got == {1: [2, 3, 1, 1], 2: [2, 5, 3, 1]}


def test_mlm_shares(spark):
    df = spark.range(3000).select("id", F.array(F.lit(2), *[F.lit(9)] * 20, F.lit(3), F.lit(1)).alias("input_ids"))
    rows = vocab.mlm_mask(df, ["id"], 50, seed=1).collect()
    targets = [(x, y) for r in rows for x, y in zip(r.input_ids, r.labels) if y != -100]
    assert all(y == 9 for _, y in targets) and 0.14 < len(targets) / 60000 < 0.16
    assert 0.77 < sum(x == 4 for x, _ in targets) / len(targets) < 0.83
    assert 0.08 < sum(x == 9 for x, _ in targets) / len(targets) < 0.14
    assert all(r.input_ids[0] == 2 and r.input_ids[21:] == [3, 1] for r in rows)


def test_truncation_audit(spark):
    text = "a 1 , b 2 , c 3 , "
    df = spark.createDataFrame([(1, text), (2, "")], "id long, text string")
    full = {r.id: r for r in vocab.truncation_audit(df, ["id"], 9).collect()}
    assert (full[1].last_name, full[1].complete, full[1].lost_share) == ("c", True, 0.0)
    cut = vocab.truncation_audit(df, ["id"], 6).orderBy("id").first()
    assert (cut.last_name, cut.complete, cut.n_kept) == ("b", False, 6)


def test_mlm_mask_draws_once_for_each_id(spark):
    """Ids inside padding, null keys and both results follow from one draw for each place."""
    import hashlib

    digest = lambda *p: hashlib.md5(":".join(str(x) for x in p if x is not None).encode()).hexdigest()
    rows = [(k, n, [2, *[5 + (i * 7) % 40 for i in range(30)], 3, *tail]) for k, n, tail in ((1, "a", [1] * 8), (None, "b", [1, 9, 1]), (None, None, []), (4, "", [1]), (5, "c", [1] * 3))]
    df = spark.createDataFrame(rows, "k long, n string, input_ids array<int>")
    masked = vocab.mlm_mask(df, ["k", "n"], 300, seed=9)
    got = {(r.k, r.n): (r.input_ids, r.labels) for r in masked.collect()}
    for k, n, ids in rows:
        shown, labels = [], []
        for i, x in enumerate(ids):
            chosen = x not in (1, 2, 3) and digest(9, "pick", k, n, i)[:8] < format(int(0.15 * 2**32), "08x")
            fate = digest(9, "fate", k, n, i)[:8]
            other = int(digest(9, "token", k, n, i)[:12], 16) % 300
            put = 4 if fate < format(int(0.8 * 2**32), "08x") else other if fate < format(int(0.9 * 2**32), "08x") else x
            shown.append(put if chosen else x)
            labels.append(x if chosen else -100)
        assert got[k, n] == (shown, labels)
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("pick") == 1


def test_chunk_texts_are_rendered_once(spark, monkeypatch):
    names = []
    kept = textrows.stage
    monkeypatch.setattr(textrows, "stage", lambda d, name: names.append(name) or kept(d, name))
    cells = spark.range(50).selectExpr("id", "'m1a' AS feature", "1D AS value")
    chunks = spark.createDataFrame([(0, ["m1a"])], "chunk_index long, chunk array<string>")
    out = textrows.render_chunks(cells, "id", chunks, "comma", min_rows=10)
    assert out.count() == 50 and "chunk_texts" in names


def test_draws_of_many_texts_are_the_plain_ones():
    import hashlib

    import pyarrow as pa

    from panelkit.functions import digests

    texts = ["", "a", "é" * 9, *("x" * n for n in range(40, 70)), *(f"7:raw:{i * 37}" for i in range(300))]
    plain = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:12], 16)
    assert digests.draws_of(pa.array(texts)).tolist() == [plain(t) for t in texts]
    row, number = np.arange(2 * len(texts)) % len(texts), np.arange(2 * len(texts)) ** 2
    assert digests.draws_of(pa.array(texts), row, number).tolist() == [plain(f"{texts[r]}:{i}") for r, i in zip(row, number)]
    assert digests.joined(["7", "size", pa.array(["b", None])]).to_pylist() == ["7:size:b", "7:size"]
    assert len(digests.draws_of(pa.array([], pa.string()))) == 0


def test_feature_subsets_are_floyds_over_many_blocks(spark, monkeypatch):
    """The sets of the plain method, also if samples come in several blocks, for a null id, and for fields of choice."""
    import hashlib

    monkeypatch.setattr(sampling, "HELD_MARKS", 40)
    rng = random.Random(4)
    names = [f"{h}{w}x" for w in range(1, 30) for h in ("cm", "m", "k")]
    rows = [(i, o, n, 1.0, f"<{n}>") for i in (1, 2, None, 4) for o, n in enumerate(names) if i != 4 and rng.random() < 0.9 or o == 3]
    df = spark.createDataFrame(rows, "id long, ord int, feature string, value double, shown string")
    out = sampling.feature_subsets(df, "id", 150, 5, 40, seed=3, fields=["shown"]).collect()
    assert len(out) == 600 and {r.sample_no for r in out} == set(range(1, 151))
    draw = lambda *p: int(hashlib.md5(":".join(str(x) for x in ("3", *p) if x is not None).encode()).hexdigest()[:12], 16)
    for r in out:
        own = [(o, n, s) for i, o, n, _, s in rows if i == r.id]
        size, left, taken = 5 + draw("size", r.id, r.sample_no) % 36, None, []
        for name in ("constructed", "raw"):
            mine = [c for c in own if c[1].startswith("cm") == (name == "constructed")]
            k = min(-(-size // 3) if left is None else left, len(mine))
            left, picks = size - k, []
            for j in range(len(mine) - k, len(mine)):
                t = draw(name, r.id, r.sample_no, j) % (j + 1)
                picks.append(j if t in picks else t)
            taken += [mine[p] for p in picks]
        assert [c.shown for c in r.cells] == [s for _, _, s in sorted(taken)]


def test_words_are_counted_and_encoded_in_batches(spark, monkeypatch):
    monkeypatch.setattr(vocab, "COUNTED_BYTES", 1)
    texts = [None, "", " ", "a  b a", "b c ", "[MASK] a x\ty é", *["a"] * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = Counter(w for t in texts for w in (t or "").split(" ") if w)
    counts = vocab.token_counts(df)
    assert {r.token: r.n for r in counts.collect()} == dict(want)
    words = vocab.top_vocab(counts, 8)
    number = {r.token: r.id for r in words.orderBy("id", ascending=False).collect()}
    got = {r.id: r for r in vocab.encode(df, ["id"], words, 5).collect()}
    for i, t in enumerate(texts):
        body = [number.get(w, 0) for w in (t or "").split(" ") if w][:3]
        assert got[i].input_ids == [2, *body, 3, *[1] * (3 - len(body))]
    plan = vocab.encode(df, ["id"], words, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_cells_without_a_name_are_not_drawn(spark):
    rows = [(i, o, n, 1.0) for i in range(40) for o, n in ((None, None), (1, "cm1x"), (2, "m1x"), (3, None))] + [(99, None, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, ord int, feature string, value double")
    out = sampling.feature_subsets(df, "id", 3, 4, 6, seed=1).collect()
    assert len(out) == 123
    assert all([c.feature for c in r.cells] == ([] if r.id == 99 else ["cm1x", "m1x"]) for r in out)
