import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from spark_trials.functions import stats
from spark_trials.operators import effects

COUNTS = "treatment_successes long, treatment_total long, control_successes long, control_total long"


def test_erfc_on_a_grid(spark):
    grid = [k / 64 for k in range(0, 64 * 12)] + [0.46875, 4.0, 20.0]
    rows = spark.createDataFrame([(x,) for x in grid], "x double").select("x", stats.erfc(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=2e-14, abs=1e-300)


def test_binary_effect(spark):
    df = spark.createDataFrame([(120, 1000, 100, 1000), (1, 100, 0, 100), (0, 100, 0, 100), (0, 0, 1, 5)], COUNTS)
    first, second, third, empty = (r.asDict() for r in effects.with_binary_effect(df).coalesce(1).collect())
    assert first["absolute_effect"] == pytest.approx(0.02) and first["relative_risk"] == pytest.approx(1.2)
    assert first["absolute_ci_low"] < 0 < first["absolute_ci_high"]
    pooled = 220 / 2000
    z = 0.02 / math.sqrt(pooled * (1 - pooled) * 2 / 1000)
    assert first["p_value_two_sided"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-12)
    assert math.isfinite(second["relative_risk"]) and third["p_value_two_sided"] == 1.0 and third["z_statistic"] == 0.0
    assert empty["p_value_two_sided"] is None and empty["treatment_rate"] is None


def test_holm_and_bh_vectors(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("g", "a", 0.5)], "f string, k string, p double")
    out = stats.with_bh(stats.with_holm(df, "p", "holm", ["f"], ["k"]), "p", "bh", ["f"], ["k"]).orderBy("f", "k").collect()
    assert [r["holm"] for r in out] == pytest.approx([0.03, 0.06, 0.06, 0.5])
    assert [r["bh"] for r in out] == pytest.approx([0.03, 0.04, 0.04, 0.5])


def test_mde(spark):
    one = spark.range(1)
    small, large, plan = (
        one.select(stats.mde(F.lit(b), F.lit(n), F.lit(n), alpha=a).alias("x")).first()["x"] for b, n, a in ((0.03, 2000, 0.05), (0.03, 20000, 0.05), (0.04, 1200, 0.05 / 6))
    )
    assert 0 < large < small < 0.03 and plan == pytest.approx(0.027839028056397323, rel=1e-12)
    with pytest.raises(ValueError):
        stats.mde(F.lit(0.1), F.lit(1), F.lit(1), alpha=0)


def test_wilson_and_upper_bound(spark):
    z = NormalDist().inv_cdf(0.975)
    low, high = stats.wilson(F.lit(0), F.lit(10), z)
    around_low, around_high = stats.wilson_around(F.lit(10), F.lit(10), z)
    row = spark.range(1).select(low, high, around_low, around_high, stats.upper_bound(F.lit(5), F.lit(100), F.lit(5), F.lit(100), 0.05 / 12)).first()
    assert row[0] == pytest.approx(0.0, abs=1e-15) and 0.2 < row[1] < 0.4 and row[2] < 1 and row[3] == 1.0 and row[4] > 0


def test_chi_square(spark):
    half = 9.0 / 2
    got = spark.range(1).select(stats.chi_square_tail(F.lit(9.0), 6), stats.chi_square_tail(F.lit(0.0), 6)).first()
    assert got[0] == pytest.approx(math.exp(-half) * (1 + half + half**2 / 2)) and got[1] == 1.0
    with pytest.raises(ValueError):
        stats.chi_square_tail(F.lit(1.0), 0)
    # the points that one in twenty exceeds
    points = {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179, 5: 11.070497693516351, 6: 12.591587243743977, 9: 16.918977604620448}
    tails = spark.range(1).select(*[stats.chi_square_tail(F.lit(x), df) for df, x in points.items()]).first()
    assert list(tails) == pytest.approx([0.05] * len(points), abs=1e-12)
