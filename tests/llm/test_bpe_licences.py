import base64

import brute
import public_tokenizers
import pytest
import tiktoken
from conftest import DOCUMENTS, rows

from panelkit.llm import bpe, license_scan, queries

ODD = ["<|endoftext|> x", "it's  THEY'LL   \n\n  go\t", "日本語 🙂🙂 é ñ", "   ", "  x ", "a" * 5000, "\x00\x01", "é", "12345 ½ ٣"]


@pytest.fixture(scope="module")
def coder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encode_and_decode(spark, write, corpus, coder):
    texts = corpus + ODD
    want = {}
    for d, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        want[d] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or ""))
    out = queries.op8_byte_bpe(spark, write(documents=(rows(texts), DOCUMENTS)))
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want


def test_offsets(spark, coder, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 1)
    texts = ["", None, *ODD, "plain words here"]
    df = spark.createDataFrame(rows(texts), DOCUMENTS)
    out = bpe.encode(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, offsets=True)
    for r in out.collect():
        text, at = texts[r.doc_id] or "", 0
        for i, start, end in zip(r.ids, r.starts, r.ends):
            size = len(coder.decode_single_token_bytes(i))
            first = len(text.encode()[: at + 1].decode(errors="ignore")) if text.encode()[at] < 0x80 else None
            at += size
            assert 0 <= start < end <= len(text)
            if first is not None:
                assert start == first - 1
        assert at == len(text.encode())


def test_stored_ids_decode(spark):
    texts = ["", None, *ODD]
    df = spark.createDataFrame(rows(texts), DOCUMENTS)
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.encode(df, path, public_tokenizers.PATTERN, decoded=True).withColumnRenamed("decoded", "at_once")
    for r in bpe.decode(both, path).collect():
        assert bytes(r.at_once) == bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    empty = df.selectExpr("cast(null AS array<int>) AS ids")
    assert all(bytes(r.decoded) == b"" for r in bpe.decode(empty, path).collect())


def test_licences(spark, write, corpus):
    texts = corpus + [
        "GNU General Public License", "the MIT License, mit-license MIT LICENSE.", "apache LICENSE\nCC-BY cc by by cc",
        "gnu general  public\tlicense2", "émit license", "cc by cc by", "mit licenses", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause)\nx",
    ]
    out = {r.doc_id: r for r in queries.op10_license_scan(spark, write(documents=(rows(texts), DOCUMENTS))).collect()}
    for d, t in enumerate(texts):
        r = out[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licences(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert out[len(texts) - 1].labels == "apache-2.0,bsd-3-clause,mit"


def test_expressions():
    sets = lambda e: [set(c) for c in license_scan.choices(e)]
    assert sets("mit") == [{"mit"}]
    assert sets("mit or apache-2.0 and isc") == [{"mit"}, {"apache-2.0", "isc"}]
    assert sets("(mit or x) and y") == [{"mit", "y"}, {"x", "y"}]
    assert sets("gpl-2.0 with classpath-exception-2.0 or mit") == [{"gpl-2.0 with classpath-exception-2.0"}, {"mit"}]
    assert sets("mit or") == sets("mit and )") == [{"mit"}]
    assert sets("") == sets("and mit") == sets("(mit") == []


def test_long_expressions(spark):
    names = [f"l-{i}" for i in range(3000)]
    every = " and ".join(names)
    grouped = " and ".join(f"({a} or {b})" for a, b in zip(names[::2], names[1::2]))
    nested = "(".join(f"{n} {'and' if i % 2 else 'or'} " for i, n in enumerate(names[:-1])) + "(" + names[-1] + ")" * (len(names) - 1)
    cases = [every, f"({every})", " or ".join(names), grouped, nested, f"(x or y) and {every}"]
    texts = [f"SPDX-License-Identifier: {e}\nnext" for e in cases]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows(texts), DOCUMENTS)).collect()}
    for d in range(len(cases)):
        assert set(out[d].labels) - {"x", "y"} == set(names), cases[d][:40]
    assert out[0].choices == out[1].choices == [" and ".join(sorted(names))]
    assert out[2].choices == sorted(names) and out[3].choices == [grouped.replace("(", "( ").replace(")", " )")]
    assert out[5].choices == sorted(" and ".join(sorted([*names, n])) for n in "xy")
    some = "(a or b) and (c or d) and e with f"
    assert license_scan.choices(some) == [frozenset([x, y, "e with f"]) for x in "ab" for y in "cd"]


def test_score(spark):
    texts = [f"see the {p} here" for p in license_scan.MORE_PHRASES] + ["no notice", None]
    texts += ["mit license " * n for n in (1, 8, 9)] + ["".join(f"SPDX-License-Identifier: l-{i}\n" for i in range(n)) for n in (4, 5)]
    score = [r.score for r in sorted(license_scan.scan(spark.createDataFrame(rows(texts), DOCUMENTS)).collect(), key=lambda r: r.doc_id)]
    n = len(license_scan.MORE_PHRASES)
    assert score[:n] == [pytest.approx(license_scan.PHRASE_WEIGHT)] * n and score[n : n + 2] == [0, 0]
    assert score[n + 2] < score[n + 3] < score[n + 4] < 1 and score[n + 5] < score[n + 6] < 1


@pytest.mark.parametrize("name", ["op8_byte_bpe", "op10_license_scan"])
def test_odd_tables(spark, write, name):
    assert queries.QUERIES[name](spark, write(documents=([], DOCUMENTS))).collect() == []
    same = [(None, "mit license", None, None, None), (None, None, None, None, None), (1, "x", None, None, 1), (1, "x", None, None, 1)]
    assert queries.QUERIES[name](spark, write(documents=(same, DOCUMENTS))).count() == 4
