"""Texts of a megabyte: time in proportion, no deep recursion."""

import random
import time

from panelkit.llm import secret_scan

MEGABYTE = 1_000_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def scanned(spark, text):
    df = secret_scan.scan(spark.createDataFrame([(text,)], "text string"))
    out = secret_scan.redact(df).first()
    return [tuple(x) for x in out.secrets], out.text


def test_secret_scan_of_one_repeated_unit(spark):
    units = ["ab-", "ab/", "a_", "a", "aB", "0", "ab1-", "A", "password", "AKIA", "2024-01-01/"]
    texts = [unit * (MEGABYTE // len(unit)) for unit in units]
    df = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8))
    out = {units[r.i]: ([tuple(x) for x in r.secrets], r.text) for r in secret_scan.redact(df).collect()}
    assert len(out) == len(units)
    for unit, text in zip(units, texts):
        if unit in ("ab-", "ab/", "a_", "aB", "A", "password"):
            assert out[unit] == ([], text)
        if unit in "a0":
            assert out[unit] == ([(0, 2, len(text))], "[secret]")


def test_secret_scan_of_an_embedded_image(spark):
    rnd = random.Random(1)
    text = "data:image/png;base64, " + "".join(rnd.choice(LETTERS) for _ in range(MEGABYTE))
    began = time.perf_counter()
    spans, left = scanned(spark, text)
    assert spans[-1][2] == len(text) and "[secret]" in left
    assert time.perf_counter() - began < 120


def test_secret_scan_of_many_spans(spark):
    rnd = random.Random(2)
    keys = ["".join(rnd.choice("0123456789abcdef") for _ in range(24)) for _ in range(20_000)]
    text = "é ".join(keys)
    began = time.perf_counter()
    spans, left = scanned(spark, text)
    assert spans == [(26 * i, 2, 26 * i + 24) for i in range(len(keys))]
    assert left == "é ".join(["[secret]"] * len(keys))
    assert time.perf_counter() - began < 120


def test_secret_scan_keeps_columns_of_its_own_names(spark):
    row = ("token=abcdefgh", "mine", "left")
    df = spark.createDataFrame([row], "text string, secret_text string, secret_left string")
    out = secret_scan.scan(df).first()
    assert (out.secret_text, out.secret_left, len(out.secrets)) == ("mine", "left", 1)
