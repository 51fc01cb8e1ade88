import numpy as np
import pytest
from pyspark.sql import functions as F

from heatscape.functions import naming
from heatscape.operators import clean as C
from heatscape.operators import roles as R
from heatscape.operators.collinearity import vif_screen, vif_table
from heatscape.operators.pooling import pool


def named(spark, names, **kw):
    d = spark.createDataFrame([(n,) for n in names], "name string")
    return {r["name"]: (r["named"]["role"], r["named"]["canonical"]) for r in naming.classify(d, "name", **kw).collect()}


def test_names(spark):
    got = named(spark, ["POINT_X", "POINT_Y", "LST_Celsius", "Ward_Name", "ndvi_mean", "mndwi_mean", "urban_index",
                        "veg_fraction", "surface_albedo", "Unnamed: 0", "system:index", "year", "foo", "bare_soil_index"])
    assert got["POINT_X"] == ("lon", "LON") and got["POINT_Y"] == ("lat", "LAT")
    assert got["LST_Celsius"] == ("lst", "LST") and got["Ward_Name"] == ("zone", "ZONE")
    assert got["ndvi_mean"] == ("index", "NDVI") and got["urban_index"] == ("index", "UI")
    assert got["veg_fraction"] == ("index", "FVC") and got["surface_albedo"] == ("index", "ALBEDO")
    assert got["Unnamed: 0"] == ("id", None) and got["system:index"] == ("id", None)
    assert got["year"] == ("year", "YEAR") and got["foo"] == ("other", None)
    assert got["bare_soil_index"] == ("index", "NDBaI")
    assert named(spark, ["bare_soil_index"], specific_first=True)["bare_soil_index"] == ("index", "BSI")


def test_roles_fallback_and_bad_coordinates(spark):
    rows = [(i * 1000, 500000.0 + i, 90.5, 20.0 + i % 7, float(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "fid int, latitude double, lon double, reading double, extra double")
    r = R.infer_roles(d, "t")
    assert r.lst == "reading" and r.lat is None and r.lon == "lon"
    assert r.extras == ("extra", "latitude") and r.dropped == ("fid",)
    # the fallback takes the first column of plausible median, even an identifier
    assert R.infer_roles(d.withColumn("fid", (F.col("fid") / 1000).cast("int")), "t").lst == "fid"


def test_clean_rules(spark):
    rng = np.random.default_rng(1)
    n = 400
    rows = [(float(300 + rng.normal()) if i % 50 else None, float(rng.integers(-9000, 9000)), 3.0,
             str(round(rng.random(), 3)) if i % 10 else "bad", float(rng.random() * 500), float(i) if i < 10 else None)
            for i in range(n)]
    d = spark.createDataFrame(rows, "LST double, NDVI double, UI double, albedo string, elev double, savi double")
    c = C.clean(d, R.infer_roles(d, "t"))
    rep = c.report.first()
    assert rep["rows_dropped_no_target"] == 8 and rep["kelvin_to_celsius"] and rep["rescaled"] == {"NDVI": 10000.0}
    assert sorted(rep["dropped_degenerate"]) == ["UI", "savi"] and rep["final_rows"] == 392
    pdf = c.frame.toPandas()
    raw = d.where("LST is not null").toPandas()
    y = raw["LST"] - 273.15
    lo, hi = y.quantile([0.002, 0.998])
    assert np.allclose(np.sort(pdf["LST"]), np.sort(y.clip(lo, hi)))
    alb = raw["albedo"].where(raw["albedo"] != "bad").astype(float)
    assert np.allclose(np.sort(pdf["albedo"]), np.sort(alb.fillna(alb.median())))
    assert pdf["elev"].max() > 100 and pdf["NDVI"].abs().max() <= 1
    assert rep["cells_imputed"] == int(alb.isna().sum())


def test_pool_keeps_shared_predictors(spark):
    def zone(name, cols):
        d = spark.range(150).select(*[(F.rand(7) + F.col("id") / 100).alias(c) for c in cols])
        return name, C.clean(d, R.infer_roles(d, name))
    a = zone("North (DNCC)", ["LST", "lat", "lon", "ndvi_mean", "NDBI", "LST_max"])
    b = zone("South (DSCC)", ["surface_temp", "POINT_Y", "POINT_X", "NDVI", "ndbi", "savi"])
    d, roles = pool([a, b])
    assert d.columns == ["LST", "LAT", "LON", "NDBI", "NDVI", "_is_north", "zone_label"] and d.count() == 300
    assert roles.features() == ["NDBI", "NDVI", "_is_north"]


def test_vif_known_truth(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=2000)
    x = np.column_stack([a, a + rng.normal(0, 0.03, 2000), rng.normal(size=2000), rng.normal(size=2000)])
    d = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    vif = {r.feature: r.vif for r in vif_table(d, d.columns).collect()}
    inv = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert list(vif.values()) == pytest.approx(list(inv), rel=1e-6) and vif["a"] > 900 and vif["c"] < 1.1
    kept, hist = vif_screen(d, d.columns)
    assert len(kept) == 3 and [r.action for r in hist.collect()] == ["removed", "retained", "retained", "retained"]
    kept, hist = vif_screen(d.select("a", "b", (F.col("a") + F.col("b")).alias("ab")), ["a", "b", "ab"])
    assert len(kept) == 2 and [r.action for r in hist.collect()] == ["removed"]


def test_columns_without_numbers_take_no_role(spark):
    d = spark.sql("SELECT id, timestamp'2020-01-01' AS ts, date'2020-01-01' AS ndvi, 20.0D + id AS lst_day, 0.1D * id AS ndbi FROM range(30)")
    r = R.infer_roles(d, "events")
    assert r.lst == "lst_day" and "ts" in r.dropped and "ndvi" in r.dropped and set(r.indices) == {"NDBI"}
