import csv
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatscape.plans.batch import Settings, run
from heatscape.sources import area_table, sinks, tables


def pixels(seed, n=420, awkward=False):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2))
    ndvi, ndbi, ndwi = rng.uniform(-1, 1, (3, n))
    lst = 30 - 6 * ndvi + 4 * ndbi + np.sin(3 * xy[:, 0]) + rng.normal(0, 0.3, n)
    if awkward:
        head = ["POINT_X", "POINT_Y", "LST_Celsius", "Ward_Name", "ndvi_mean", "ndbi_mean", "ndwi_mean"]
        cols = [90 + xy[:, 0], 23 + xy[:, 1], lst + 273.15, [f"w{i % 5}" for i in range(n)],
                np.round(ndvi * 10000), np.round(ndbi * 10000), ndwi]
    else:
        head = ["longitude", "latitude", "LST", "NDVI", "NDBI", "NDWI"]
        cols = [90 + xy[:, 0], 23 + xy[:, 1], lst, ndvi, ndbi, ndwi]
    return [head, *[list(r) for r in zip(*cols)]]


def write(path, rows, sep=","):
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter=sep).writerows(rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    write(root / "pixels_south.csv", pixels(1))
    write(root / "pixels_north.csv", pixels(2, awkward=True))
    os.makedirs(root / "deep" / "__MACOSX")
    write(root / "deep" / "ward_trend.tsv", [["ward", *range(1990, 2026, 5)],
                                             *[[f"w{k}", *[20 + 0.5 * i + 0.01 * k * (-1) ** i for i in range(8)]]
                                               for k in range(3)]], "\t")
    write(root / "deep" / "__MACOSX" / "junk.csv", [["a", "b"], [1, 2]])
    write(root / "single.csv", [["only"], [1]])
    write(root / "south annual.txt", [["zone", "year", "LST_mean"], *[["S", 1990 + 5 * i, 20 + i] for i in range(8)]])
    inner = root / "tmp_extra.csv"
    write(inner, pixels(3, 150))
    with zipfile.ZipFile(root / "bundle.zip", "w") as z:
        z.write(inner, "sub/extra_2020.csv")
        z.writestr("sub/pixels_south.csv", "a,b\n1,x\n2,y\n")
        z.writestr("../readme.md", "no table")
    os.rename(inner, root / "tmp_extra.skip")
    return str(root)


def test_discovery(spark, folder):
    found = tables.discover_inputs(spark, folder)
    assert set(found) == {"pixels_south", "pixels_north", "ward_trend", "south annual", "extra_2020", "pixels_south_2"}
    assert found["extra_2020"].count() == 150 and dict(found["extra_2020"].dtypes)["LST"] == "double"
    assert found["pixels_south_2"].columns == ["a", "b"] and found["pixels_south_2"].count() == 2
    assert found["ward_trend"].columns[1] == "1990"


def test_broken_file_is_skipped(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    assert tables.read_any(spark, str(tmp_path / "bad.parquet")) is None


@pytest.mark.parametrize("blank", [",,,,\r\n", "\r\n"])
def test_area_table(spark, tmp_path, blank):
    text = ("\"Some City (AB) - Areas in km2\",,,,\r\n" + blank + "Year,NDVI (Veg),,UHI (Heat),\r\n,Low,High,Cool,Hot\r\n"
            "1990,6,4,3,7\r\n1995,5,5,2.5,7.5\r\n")
    (tmp_path / "areas.csv").write_bytes(text.encode())
    d = area_table.read_area_table(spark, str(tmp_path / "areas.csv"), "AB")
    rows = {(r["year"], r["index"], r["class"]): r["area_km2"] for r in d.collect()}
    assert len(rows) == 8 and rows[(1995, "UHI (Heat)", "Hot")] == 7.5 and rows[(1990, "NDVI (Veg)", "High")] == 4
    share = {(r["year"], r["class"]): r["share"] for r in area_table.area_shares(d).collect()}
    assert share[(1990, "Low")] == pytest.approx(0.6)
    delta = {(r["year"], r["class"]): r["delta_km2"] for r in area_table.epoch_change(d).collect()}
    assert delta[(1995, "Hot")] == 0.5 and delta[(1990, "Hot")] is None
    assert d.groupBy("year", "index").agg(F.sum("area_km2").alias("t")).where("t <> 10").count() == 0


def test_whole_run_and_sinks(spark, folder, tmp_path):
    found = tables.discover_inputs(spark, folder)
    found.pop("pixels_south_2")
    s = Settings(trees=4, rounds=3, depth=3, model_names=("OLS", "LightGBM"), gwr_points=200, n_perm=5, shap_rows=300,
                 cluster_counts=(3, 4))
    out = run(found, s)
    bench = out["model_benchmark"].collect()
    zones = {r["Zone"] for r in bench}
    assert zones == {"South (DSCC)", "North (DNCC)", "Unassigned", "Pooled (N+S)"}
    assert all(r["R2"] > 0.9 for r in bench if r["Model"] == "OLS")
    assert out["temporal_trends"].where("Trend = 'increasing'").count() == 4
    assert {r["Zone"] for r in out["temporal_trends"].collect()} == {"Unassigned", "South (DSCC)"}
    gate = out["gatekeeper_validation"].collect()
    assert len(gate) == 4 and all(0.75 < r["empirical_coverage"] <= 1 for r in gate)
    assert out["change_detection_drivers"].count() == 3
    kelvin = {r["table"]: r["kelvin_to_celsius"] for r in out["cleaning"].collect()}
    assert kelvin["pixels_north"] and not kelvin["pixels_south"]
    done = sinks.write_results(out, str(tmp_path / "results"))
    assert len(done) == len(sinks.RESULT_TABLES)
    back = tables.read_csv(spark, str(tmp_path / "results" / "model_benchmark"))
    assert back.count() == len(bench) and back.columns[0] == "Zone"
    status = out["stage_status"].collect()
    assert {r["status"] for r in status} == {"ok"} and {r["Zone"] for r in status} >= zones
    assert {r["stage"] for r in status} >= {"vif_screening", "model_benchmark", "gwr", "shap", "gatekeeper", "climate_zones", "change_detection"}


def test_a_failing_model_and_stage_leave_the_rest(spark, folder, monkeypatch):
    from heatscape.operators import linear
    from heatscape.plans import batch

    def broken(df, features, y):
        raise ValueError("this model has no solution\nand a long story")

    def no_fits(*args, **kw):
        raise RuntimeError("singular")

    monkeypatch.setattr(batch.gwr, "gwr", no_fits)
    found = {k: v for k, v in tables.discover_inputs(spark, folder).items() if k == "pixels_south"}
    out = run(found, Settings(cluster_counts=(3,), audit_model="OLS"), zoo={"OLS": linear.fit_ols, "Broken": broken})
    status = {(r["stage"], r["status"]): r["message"] for r in out["stage_status"].collect()}
    assert status["model Broken", "failed"] == "ValueError: this model has no solution"
    assert status["gwr", "failed"] == "RuntimeError: singular"
    assert {s for s, how in status if how == "ok"} >= {"vif_screening", "model_benchmark", "spatial_leakage_audit", "shap", "gatekeeper", "climate_zones"}
    assert [r["Model"] for r in out["model_benchmark"].collect()] == ["OLS"] and out["gatekeeper_scores"].count() > 0
    assert out["shap_feature_importance"].count() >= 2 and "gwr_runs" not in out
