"""The Thue-Morse word and its complement meet under any polynomial hash modulo a power of two."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import DOCUMENTS, rows
from test_corpus import ITEMS, brute_matches

from panelkit.llm import grams, quality_classifier, queries

BITS = [bin(i).count("1") % 2 for i in range(2048)]
ONE, TWO = ("".join("ab"[b ^ x] for b in BITS) for x in (0, 1))


@pytest.fixture(scope="module")
def texts():
    spread = lambda a, b: " ".join([a, b][x] for x in BITS)
    return [" ".join([ONE] * 50), " ".join([TWO] * 50), f"{ONE} x", f"{TWO} x", ONE, TWO, spread("ab", "cd"), spread("cd", "ab"), f"one two {ONE} four five six", f"one two {TWO} four five six"]


def test_repeats(spark, write, texts):
    sf = write(documents=(rows(texts), DOCUMENTS))
    got = lambda df: {r[0]: tuple(r[1:]) for r in df.collect()}
    assert got(queries.op1_substring_dedup(spark, sf)) == brute.word_repeats(list(enumerate(texts)))
    assert got(queries.op7_suffix_dedup(spark, sf)) == brute.byte_repeats(list(enumerate(texts)))


def test_near_copies(spark, write, texts):
    sf = write(documents=(rows(texts), DOCUMENTS))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_minhash_forest(spark, sf).collect()}
    assert got == brute.near_duplicates(list(enumerate(texts)), 2)
    assert got[3][1] == 3


def test_leaks(spark, write, texts):
    items = [(1, texts[8]), (2, f"{TWO} {ONE} a b c")]
    sf = write(documents=(rows(texts), DOCUMENTS), benchmark=(items, ITEMS))
    got = {(r[0], r[1]) for r in queries.op6_decontamination(spark, sf).collect()}
    assert got == set(brute_matches(list(enumerate(texts)), items)) == {(8, 1)}


def test_features_differ(texts):
    slots = [quality_classifier.features(next(grams.pieces(pa.array([t]))))[0].tolist() for t in texts[4:6]]
    assert slots[0] != slots[1]


def test_prefix_sums_are_exact():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    sums, total = grams.prefix(values), 0
    for i, v in enumerate(values.tolist()):
        total = (total + v * pow(grams._BASE, i, grams._PRIME)) % grams._PRIME
        assert total == int(sums[i + 1])
    at = np.arange(2990)
    assert (grams.slice_hash(sums, at, at + 7) == grams.gram_hash(sums, 7)[:2990]).all()
