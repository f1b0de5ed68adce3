"""Documented frequency tables of nine coded columns, 4,242 rows each."""

import pytest
from pyspark.sql import functions as F

from panelkit.functions import codes
from panelkit.operators import clean, evaluate, panel

FREQUENCIES = {
    "cm1ethrace": {-9: 1, -3: 5, 1: 933, 2: 2090, 3: 1050, 4: 163},
    "cm1edu": {-9: 1, -3: 3, 1: 1402, 2: 1307, 3: 1064, 4: 465},
    "cm1relf": {-9: 1, -3: 1, 1: 1030, 2: 1520, 3: 1130, 4: 255, 5: 159, 6: 120, 7: 26},
    "t5c13a": {-9: 2228, -3: 1, -2: 7, -1: 6, 1: 193, 2: 531, 3: 728, 4: 441, 5: 107},
    "t5c13b": {-9: 2228, -3: 1, -2: 6, -1: 10, 1: 125, 2: 364, 3: 1057, 4: 393, 5: 58},
    "t5c13c": {-9: 2228, -3: 1, -2: 8, -1: 8, 1: 179, 2: 501, 3: 779, 4: 448, 5: 90},
    "t5b2b": {-9: 2228, -2: 1, -1: 6, 1: 153, 2: 638, 3: 644, 4: 572},
    "t5b4y": {-9: 2228, -3: 1, -2: 2, -1: 6, 0: 960, 1: 600, 2: 279, 3: 166},
    "t5b4z": {-9: 2228, -3: 1, -2: 4, -1: 5, 0: 1053, 1: 525, 2: 263, 3: 163},
}
# valid, distinct, mean, population deviation, median, below, equal, above, zeros, ones
EXPECTED = {
    "cm1ethrace": (4236, 4, 2.104580, 0.781737, 2, 933, 2090, 1213, 3023, 1213),
    "cm1edu": (4238, 4, 2.139689, 1.000626, 2, 1402, 1307, 1529, 2709, 1529),
    "cm1relf": (4240, 7, 2.400236, 1.238323, 2, 1030, 1520, 1690, 2550, 1690),
    "t5c13a": (2000, 5, 2.869000, 1.033847, 3, 724, 728, 548, 724, 1276),
    "t5c13b": (1997, 5, 2.947421, 0.861890, 3, 489, 1057, 451, 489, 1508),
    "t5c13c": (1997, 5, 2.884326, 1.000320, 3, 680, 779, 538, 680, 1317),
    "t5b2b": (2007, 4, 2.814649, 0.934595, 3, 791, 644, 572, 791, 1216),
    "t5b4y": (2005, 4, 0.825935, 0.958555, 1, 960, 600, 445, 960, 1045),
    "t5b4z": (2004, 4, 0.768463, 0.963549, 0, 0, 1053, 951, 1053, 951),
}
N = 4242


@pytest.fixture(scope="module")
def wide(spark):
    rows = [[float(v) for v, n in f.items() for _ in range(n)] for f in FREQUENCIES.values()]
    schema = "challengeID long, " + ", ".join(f"{c} double" for c in FREQUENCIES)
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(zip(*rows, strict=True))], schema).cache()


def test_profile_and_split(wide):
    cells = panel.melt(wide, "challengeID").cache()
    profile = {r.feature: r for r in panel.column_profile(cells).collect()}
    split = {r.feature: r for r in panel.median_split(cells).collect()}
    for name, (valid, distinct, _, std, median, below, equal, above, zeros, ones) in EXPECTED.items():
        p, s = profile[name], split[name]
        assert (p.n_valid, p.n_unique) == (valid, distinct)
        assert p.std == pytest.approx(std, abs=1e-5)
        assert (s.n_rows, s.n_valid, s.median) == (N, valid, median)
        assert (s.below, s.equal, s.above, s.zeros, s.ones) == (below, equal, above, zeros, ones)
        assert s.dense and s.balanced
    bits = panel.binarize_cells(cells, panel.median_split(cells)).groupBy("feature").agg(
        F.count_if(F.col("value") == 0).alias("z"), F.count_if(F.col("value") == 1).alias("o"), F.count("*").alias("n")
    )
    for r in bits.collect():
        assert (r.z, r.o, r.n) == (*EXPECTED[r.feature][-2:], N)


def test_mean_and_five_number(wide):
    clean_ = clean.clean_sentinels(wide, list(FREQUENCIES))
    for name in ("cm1edu", "t5b4y"):
        r = evaluate.five_number(clean_, [], name).first()
        assert r["mean"] == pytest.approx(EXPECTED[name][2], abs=1e-5)
        assert r["std_pop"] == pytest.approx(EXPECTED[name][3], abs=1e-5)
        assert r["median"] == EXPECTED[name][4]


def test_indicators_and_proxy(wide):
    from panelkit.plans.jobs import baseline_features

    feats = baseline_features(wide)
    assert feats.columns == [*clean.BASELINE_COLUMNS, "gpa_proxy"]
    sums = feats.agg(*[F.sum(c).alias(c) for c in feats.columns if c[:4] in ("race", "mari")], F.avg("gpa_proxy").alias("g")).first()
    assert [sums[c] for c in ("race_black", "race_hispanic", "race_others")] == [2096, 1050, 1096]
    assert [sums[c] for c in ("marital_married", "marital_cohab", "marital_others")] == [1030, 1522, 1690]
    assert sums["g"] == pytest.approx(2.900249, abs=1e-5)


def test_fixed_tables():
    assert set(codes.FOUR_FACTOR_R2) == set(codes.TRAINING_MEANS) == {*codes.REGRESSION_TASKS, *codes.BINARY_TASKS}
