import random

import brute
import pytest
from conftest import DOCUMENTS, rows

from panelkit.llm import minhash_forest, queries


@pytest.fixture(scope="module")
def texts(corpus):
    """Groups whose members lie around the bound, chains of links, copies and one-word texts."""
    rnd = random.Random(2)
    out = list(corpus) + ["Word", "word", "word two", "WORD two", "a b c d e f", "a b c d e g", "b c d e f"]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rnd.choice([12, 40, 150]))]
        for _ in range(14):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            out.append(" ".join(w))
    rnd.shuffle(out)
    return out


def got(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_pairs_of_words(spark, write, texts):
    assert got(queries.op5_minhash_forest(spark, write(documents=(rows(texts), DOCUMENTS)))) == brute.near_duplicates(list(enumerate(texts)), 2)


@pytest.mark.parametrize("region_rows", [1, 3])
def test_five_words_and_deep_regions(spark, write, texts, region_rows):
    docs = spark.createDataFrame(rows(texts), DOCUMENTS)
    assert got(minhash_forest.near_duplicates(docs, region_rows=region_rows)) == brute.near_duplicates(list(enumerate(texts)), 5)


def test_odd_rows(spark):
    data = [(None, "a b c", 1), (None, None, 2), (3, "a b c", 3), (3, "a b c", 4), (2, "A B C", 5), (4, "", None), (5, None, 0)]
    out = minhash_forest.near_duplicates(spark.createDataFrame(data, "doc_id long, text string, component_id int"))
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in out.collect())
    assert found == [(-1, 0, -1, True), (-1, 1, -1, True), (2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_empty_table(spark, write):
    assert queries.op5_minhash_forest(spark, write(documents=([], DOCUMENTS))).collect() == []
