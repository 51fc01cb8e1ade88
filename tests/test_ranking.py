import numpy as np
import pytest
from pyspark.sql import functions as F

from heatscape.functions import ranking
from heatscape.functions.ranking import global_rank, quantiles

LEVELS = [0.0, 0.002, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.exponential(3.0, 9000), np.full(6000, 2.5), [-1e9, 1e9]])
    g = np.where(np.arange(len(v)) % 10 < 7, "hot", np.where(np.arange(len(v)) % 2, "b", "c"))
    return spark.createDataFrame([(i, str(a), float(x)) for i, (a, x) in enumerate(zip(g, v))], "id long, g string, v double")


@pytest.mark.parametrize("kw", [{}, {"small_rows": 0}, {"small_rows": 0, "max_groups": 1}])
def test_three_ways_to_quantiles_agree(rows, kw):
    got = {r["g"]: r for r in quantiles(rows, "v", LEVELS, ["g"], **kw).collect()}
    pdf = rows.toPandas()
    for g, d in pdf.groupby("g"):
        assert got[g]["n"] == len(d)
        assert got[g]["q"] == pytest.approx(list(np.quantile(d["v"], LEVELS)), rel=1e-12)


def test_ungrouped_bin_counts(rows):
    q = quantiles(rows, "v", LEVELS, small_rows=0).first()["q"]
    assert q == pytest.approx(list(np.quantile(rows.toPandas()["v"], LEVELS)), rel=1e-12)


def test_global_rank_is_row_number(rows):
    pdf = rows.toPandas().sort_values(["g", "v", "id"])
    want = {int(i): int(r) for i, r in zip(pdf["id"], pdf.groupby("g").cumcount())}
    got = {r["id"]: r["rank"] for r in global_rank(rows, ["v", "id"], ["g"]).collect()}
    assert got == want
    whole = {r["id"]: r["rank"] for r in global_rank(rows, ["v", "id"]).collect()}
    order = rows.toPandas().sort_values(["v", "id"])["id"].tolist()
    assert [whole[i] for i in order] == list(range(len(order)))


def test_one_value_only(spark):
    d = spark.range(5000).select(F.lit(4.0).alias("v"))
    assert quantiles(d, "v", [0.5], small_rows=0).first()["q"] == [4.0]


@pytest.mark.parametrize("kw", [{}, {"small_rows": 0}, {"small_rows": 0, "max_groups": 1}])
def test_infinities_are_values_and_nan_is_missing(spark, kw):
    v = F.when(F.col("id") < 3, float("-inf")).when(F.col("id") > 4990, float("inf")).when(F.col("id") == 9, float("nan"))
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), v.otherwise(F.col("id") * 1e305).alias("v"))
    levels = [0.0, 0.25, 0.5, 1.0]
    got = {r["g"]: r for r in quantiles(rows, "v", levels, ["g"], **kw).collect()}
    for g, d in rows.where("NOT isnan(v)").toPandas().groupby("g"):
        s = sorted(d["v"])
        low, high = int((len(s) - 1) * 0.25), int((len(s) - 1) * 0.5)
        assert got[g]["n"] == len(s)
        q = got[g]["q"]
        assert q[0] == float("-inf") and q[3] == float("inf")
        assert s[low] <= q[1] <= s[low + 1] and s[high] <= q[2] <= s[high + 1]


def test_many_quantiles_fetch_the_wanted_values_only(rows, monkeypatch):
    monkeypatch.setattr(ranking, "values_at", lambda *_: pytest.fail("bins were fetched"))
    levels = [i / 90 for i in range(91)]
    got = {r["g"]: r["q"] for r in quantiles(rows, "v", levels, ["g"], small_rows=0).collect()}
    for g, d in rows.toPandas().groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(d["v"], levels)), rel=1e-12)
