import brute
import pytest
from conftest import DOCUMENTS, rows

from panelkit.llm import grams, queries, substring_dedup, suffix_dedup


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.fixture(scope="module")
def sf(write, corpus):
    return write(documents=(rows(corpus), DOCUMENTS))


def test_words(spark, sf, corpus):
    assert got(queries.op1_substring_dedup(spark, sf)) == brute.word_repeats(list(enumerate(corpus)))


def test_bytes(spark, sf, corpus):
    assert got(queries.op7_suffix_dedup(spark, sf)) == brute.byte_repeats(list(enumerate(corpus)))


@pytest.mark.parametrize("bucket_rows", [0, 30])
def test_large_buckets_are_split_with_the_same_result(spark, sf, bucket_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: {r.doc_id: (r.n_removed, r.kept) for r in df.collect()}
    assert key(suffix_dedup.remove_repeats(docs, bucket_rows=bucket_rows)) == key(suffix_dedup.remove_repeats(docs))


def test_other_windows(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute.repeats(list(enumerate(corpus)), lambda t: brute.WORD.findall(t or ""), 11)
    for r in substring_dedup.remove_repeats(docs, window=11).collect():
        v, f = want[r.doc_id]
        assert r.kept == " ".join(w for w, x in zip(v, f) if not x)
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == sum(f)


def test_small_pieces_and_parts(spark, sf, corpus, monkeypatch):
    """Runs cut at part borders give the same result."""
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["ab cd " * 500, "x" * 700, None, "ab cd " * 400])
    (piece,) = grams.pieces(texts)
    sums = grams.prefix(grams.BYTE_VALUES[piece.data])
    whole = grams.segments(sums, piece.offsets, 50, 20)
    monkeypatch.setattr(grams, "PART", 97)
    cut = grams.segments(sums, piece.offsets, 50, 20)
    covered = lambda s: np.concatenate([np.arange(a, a + n) for a, n in zip(s.start, s.count)])
    assert (np.sort(covered(whole)) == np.sort(covered(cut))).all()
    assert len(list(grams.pieces(texts, 10))) == 4


@pytest.mark.parametrize("op", [substring_dedup.remove_repeats, suffix_dedup.remove_repeats])
def test_odd_rows(spark, op):
    long = " ".join(f"w{i}" for i in range(90))
    data = [(None, long, 1), (None, None, 2), (3, long, 3), (3, long, 4), (3, "other " * 60, 5), (4, long, 6), (5, None, None)]
    out = op(spark.createDataFrame(data, "doc_id long, text string, kept int"))
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in out.collect())
    full = 90 if op is substring_dedup.remove_repeats else len(long)
    assert found == [(-1, 0), (-1, 0), (3, 0), (3, 0), (3, 0), (4, full), (5, 0)]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op7_suffix_dedup"])
def test_empty_table(spark, write, name):
    assert queries.QUERIES[name](spark, write(documents=([], DOCUMENTS))).collect() == []
