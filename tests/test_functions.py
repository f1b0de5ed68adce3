import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from panelkit.functions import arrays, codes, draws, names
from panelkit.functions import text as tx


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, c {type_}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def masked(text):
    """A state machine over characters."""
    out = ""
    for ch in text:
        if not ch.isdigit():
            out += ch
        elif not out.endswith("*"):
            out += "*"
    return out


def random_texts(alphabet, n=1500, longest=14):
    rng = random.Random(1)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_mask_numbers_matches_state_machine(spark):
    texts = random_texts("12*a ٣²①x") + ["", "*12", "1*2", "**12", "12*"]
    assert column(spark, texts, tx.mask_numbers("c")) == [masked(s) for s in texts]


def test_words_match_python_split(spark):
    texts = random_texts("ab \t\n  \x1c\x0b") + ["", " ", "a"]
    assert column(spark, texts, tx.words("c")) == [s.split() for s in texts]
    assert column(spark, texts, tx.is_blank("c")) == [not s.strip() for s in texts]


def test_is_float_matches_python(spark):
    def parses(s):
        try:
            float(s)
            return True
        except ValueError:
            return False

    texts = [s for s in random_texts("1_.e-+0") if s] + ["inf", "-Infinity", "NaN", "1d", "1f", "0x1", ",", "1__0", "1_0.5"]
    assert column(spark, texts, tx.is_float("c")) == [parses(s) for s in texts]


def test_number_after(spark):
    texts = ["he was aged 71 then", "aged", "aged x 5", "aged 5 aged 6", "x aged ten aged 6", "aged\n42"]
    assert column(spark, texts, tx.number_after("c", "aged")) == [71, None, None, 5, None, 42]


def test_names(spark):
    listed = ["cm1ethrace", "m5f23d", "nodigit", "a1b", "ab1", "cf4x9"]
    assert column(spark, listed, names.wave_of("c")) == ["1", "5", "999", "1", "1", "4"]
    assert column(spark, listed, names.stem_of("c")) == ["cmethrace", "mf23d", "nodigit", "ab", "ab", "cfx9"]
    assert column(spark, listed, names.class_prefix("c")) == ["constructed", "raw", "raw", "raw", "raw", "constructed"]
    assert column(spark, [["3", "1"]], names.wave_set_code(F.col("c")), "array<string>") == [13]


def test_codes(spark):
    assert column(spark, [-9.0, 0.0, 2.0, None, float("nan")], codes.sentinel_to_null("c"), "double") == [None, 0, 2, None, None]
    assert column(spark, ["Missing", "x", None], codes.is_valid(text="c")) == [False, True, False]
    assert column(spark, [float("nan"), -1.0, 0.0, None], codes.is_valid("c"), "double") == [False, False, True, False]
    tied = codes.binarize(F.col("c"), F.lit(2.0), F.lit(True))
    assert column(spark, [1.0, 2.0, 3.0, None], tied, "double") == [0, 0, 1, None]
    tied = codes.binarize(F.col("c"), F.lit(2.0), F.lit(False))
    assert column(spark, [1.0, 2.0, 3.0, None], tied, "double") == [0, 1, 1, None]


def test_parsers(spark):
    assert column(spark, ["['a', 'b']", '["it\'s", \'c\']', "[]"], arrays.parse_list_literal("c")) == [["a", "b"], ["it's", "c"], []]
    assert column(spark, ["[0.1  -2.\n 3e-2]", "[ 1 ]"], arrays.parse_vector("c")) == [[0.1, -2.0, 0.03], [1.0]]
    assert column(spark, [[1.0, 5.0, 5.0]], arrays.argmax(F.col("c")), "array<double>") == [1]


def test_distinct_draws(spark):
    # Sizes around squares, where the walk beyond m is shortest and longest, and one beyond 32 bits.
    sizes = [*range(7, 60), 99, 100, 101, 1022, 1024, 1026, 10**6 + 3, 2**40 + 1]
    df = spark.createDataFrame([(m, i) for m in sizes for i in range(3)], "m long, id long").repartition(4)
    for r in df.select("m", draws.distinct_draws(F.col("m"), 7, 1, "id", "m").alias("p")).collect():
        assert len(r.p) == len(set(r.p)) == 7 and all(0 <= x < r.m for x in r.p)
    # All positions of a group in one draw: a permutation.
    full = spark.range(50).select(draws.distinct_draws(F.lit(41), 41, 1, "id").alias("p")).collect()
    assert all(sorted(r.p) == list(range(41)) for r in full) and len({tuple(r.p) for r in full}) == 50
    # Every position, and every pair of them, has the same chance.
    big = spark.range(6000).select(draws.distinct_draws(F.lit(10), 3, 2, "id").alias("p"))
    rows = [r.p for r in big.collect()]
    for chosen, expected in ([p for r in rows for p in r], 1800), ([frozenset(q) for r in rows for q in itertools.combinations(r, 2)], 400):
        counts = collections.Counter(chosen).values()
        assert max(counts) < 1.25 * expected and min(counts) > 0.75 * expected
    assert len(set(chosen)) == 45
    with pytest.raises(Exception, match="cannot draw 7 rows out of 6"):
        spark.range(1).select(draws.distinct_draws(F.lit(6), 7, 1, "id")).collect()


def test_distinct_positions(spark):
    df = spark.range(200).select("id", (F.col("id") % 9 + 1).alias("m"), (F.col("id") % 4).alias("k")).where("k <= m")
    for r in df.select("m", "k", draws.distinct_positions(F.col("m"), F.col("k"), 1, "id").alias("p")).collect():
        assert len(r.p) == len(set(r.p)) == r.k and all(0 <= x < r.m for x in r.p)
    rows = [r[0] for r in spark.range(6000).select(draws.distinct_positions(F.lit(6), F.lit(3), 2, "id")).collect()]
    counts = collections.Counter(frozenset(r) for r in rows)
    assert len(counts) == 20 and max(counts.values()) < 1.3 * 300 and min(counts.values()) > 0.7 * 300


def test_positions_are_floyds_in_order(spark):
    """Few positions are bits of a number, many a list; both give the sets of the plain method."""
    def plain(m, k, *keys):
        picks = []
        for j in range(m - k, m):
            text = ":".join(str(x) for x in ("3", *keys, j) if x is not None)
            drawn = int(hashlib.md5(text.encode()).hexdigest()[:12], 16) % (j + 1)
            picks.append(j if drawn in picks else drawn)
        return sorted(picks)

    rows = [(i if i % 7 else None, m, k) for i in range(40) for m, k in ((1, 1), (9, 0), (9, 5), (63, 20), (64, 20), (200, 90))]
    df = spark.createDataFrame(rows, "id long, m int, k int")
    got = df.select("id", "m", "k", draws.distinct_positions(F.col("m"), F.col("k"), 3, F.lit("x"), "id").alias("p")).collect()
    assert len(got) == len(rows) and all(r.p == plain(r.m, r.k, "x", r.id) for r in got)


def test_cell_styles(spark):
    def shown(value, style):
        df = spark.createDataFrame([("q1", value)], "n string, v double")
        return df.select(tx.cell_text(F.col("n"), F.col("v"), style)).first()[0]

    assert shown(2.9, "plain") == "q1 2 " and shown(None, "plain") is None
    assert shown(2.0, "comma") == "q1 2 , " and shown(None, "comma") is None
    assert shown(2.0, "raw") == "q1 2.0 , " and shown(None, "raw") == "q1 nan , "
    assert shown(2.0, "token") == "q1_2 " and shown(None, "token") == "q1_# "
