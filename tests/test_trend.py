import numpy as np
import pytest

from heatscape.functions.series import falling_pairs
from heatscape.operators import trend



def numpy_statistics(v):
    n = len(v)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    s = sum(np.sign(v[j] - v[i]) for i, j in pairs)
    return s, np.median([(v[j] - v[i]) / (j - i) for i, j in pairs])


def frame(spark, series):
    return spark.createDataFrame([(u, y, float(v)) for u, vals in series.items() for y, v in enumerate(vals, 1990)],
                                 "unit string, year int, value double")


def test_known_slope_and_published_p(spark):
    # a rising series of eight steps: S = 24 and S = 18 give the well known p-values
    up24 = [1.0, 2.0, 3.0, 4.0, 6.0, 5.0, 8.0, 7.0]
    d = frame(spark, {"a": up24, "b": [5.0] * 8, "short": [1.0, 2.0, 3.0, 4.0]})
    got = {r["unit"]: r for r in trend.mann_kendall(d).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["s"] == 24 and got["a"]["tau"] == pytest.approx(24 / 28)
    assert got["a"]["p"] == pytest.approx(0.004434, abs=1e-6)
    assert got["a"]["trend"] == "increasing"
    assert got["b"]["p"] == pytest.approx(1.0, abs=1e-6) and got["b"]["trend"] == "no trend"


def test_linear_series_has_its_slope(spark):
    rng = np.random.default_rng(3)
    v = 20 + 0.05 * np.arange(40) + rng.normal(0, 0.02, 40)
    r = trend.trend_table(frame(spark, {"u": v}), "Z").first()
    assert r["Sen_slope_per_step"] == pytest.approx(0.05, abs=0.005)
    assert r["Sen_slope_per_decade"] == pytest.approx(10 * r["Sen_slope_per_step"])
    assert r["Trend"] == "increasing" and r["Years"] == "1990-2029" and r["N_obs"] == 40
    assert r["First_period_mean"] == pytest.approx(v[:13].mean()) and r["Last_period_mean"] == pytest.approx(v[-13:].mean())


@pytest.mark.parametrize("n", [5, 6, 60])
def test_both_ways_to_pair_statistics(spark, n):
    rng = np.random.default_rng(n)
    series = {"x": rng.normal(size=n), "ties": np.round(rng.normal(size=n), 0)}
    d = frame(spark, series)
    for limit in (1024, 2):
        got = {r["unit"]: r for r in trend.pair_statistics(d, pairwise_limit=limit).collect()}
        for u, v in series.items():
            s, slope = numpy_statistics(v)
            assert got[u]["s"] == s
            assert got[u]["slope"] == pytest.approx(slope, abs=1e-9)
    rows = trend.pair_statistics(d, pairwise_limit=2).collect()
    again = trend.pair_statistics(d).collect()
    assert {r["unit"]: r["ties"] for r in rows} == {r["unit"]: r["ties"] for r in again}


def test_falling_pairs_counts():
    rng = np.random.default_rng(0)
    for n in (1, 5, 128, 129, 700):
        a = np.round(rng.normal(size=n), 1)
        assert falling_pairs(a) == sum(int((a[i + 1:] <= a[i]).sum()) for i in range(n))


def test_tidy_wide_long_and_detected(spark):
    wide = spark.createDataFrame([("w1", "1.5", 2.0, None), ("w2", "x", 4.0, 5.0)], "ward string, `1990` string, `1995` double, `2000` double")
    got = sorted((r.unit, r.year, r.value) for r in trend.tidy(wide).collect())
    assert got == [("w1", 1990, 1.5), ("w1", 1995, 2.0), ("w2", 1995, 4.0), ("w2", 2000, 5.0)]
    long = spark.createDataFrame([(30.0, 20.0, y) for y in range(1990, 1996)], "LST_max double, LST_mean double, year int")
    assert trend.tidy(long).agg({"value": "max"}).first()[0] == 30.0
    assert trend.tidy(long, "LST_mean").agg({"value": "max"}).first()[0] == 20.0
    odd = spark.createDataFrame([(y, 1.0 * y, 25.0) for y in range(1990, 1996)], "season int, far double, surface_temp double")
    assert trend.tidy(odd.select("season", "far")).select("value").first()[0] == 1990.0
    none = spark.createDataFrame([("a", 1.0)], "name string, v double")
    assert trend.tidy(none) is None


def test_years_from_dates(spark):
    rows = [(f"{y}-06-30", 20.0 + (y - 1990) * 0.1 + i) for y in range(1990, 1999) for i in (0, 1)]
    dated = spark.createDataFrame(rows, "year string, lst double").selectExpr("cast(year as date) as year", "lst")
    stamped = dated.selectExpr("cast(year as timestamp) as taken", "lst")
    for d in (dated, stamped):
        long = trend.tidy(d)
        assert {r["year"] for r in long.collect()} == set(range(1990, 1999)) and long.count() == 18
        row = trend.trend_table(long, "z").first()
        assert row["Trend"] == "increasing"
