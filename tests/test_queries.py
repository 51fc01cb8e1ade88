"""Registered queries against their SQL; HEATSCAPE_ALL=1 takes every one of them."""

import os

import pytest
from compare import connection, difference

from heatscape.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "a6_area_shares", "a7_result_sink", "b1_normalise_names", "b2_classify_names", "b3_assign_roles", "b8_route_tables",
    "c9_cleaning_report", "c12_sizeable_zones", "d2_backward_screen", "e1_nearest_centre_blocks", "e4_group_folds",
    "e6_morans_i", "e8_knn_features", "f2_ridge_loo", "f8_benchmark", "f9_leakage_audit", "f11_refit_split",
    "g1_local_regression", "g4_aicc_gate", "g6_driver_summary", "h1_sampled_shap", "h2_importance", "h4_local_explanations",
    "h5_permutation_importance", "i6_conformal_quantile", "i11_score", "i14_stress", "i15_spearman", "j7_trend_table",
    "j9_rank_aligned_change", "k1_silhouette", "k4_signatures", "l1_dependence_curve", "l6_steepest_series", "l8_report_rollup",
]
NAMES = sorted(catalogue.SQL) if os.environ.get("HEATSCAPE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert difference(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.SQL[name]) is None


def test_every_sql_has_its_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert not [n for n in catalogue.QUERIES if "pipeline" in n or n.startswith("op")]


def test_plans_prune_and_push_down(spark, capsys):
    catalogue.QUERIES["c1_project_roles"](spark, FOLDER).explain("formatted")
    text = capsys.readouterr().out
    assert "l_linestatus" not in text and "l_shipdate" not in text and "CartesianProduct" not in text
    catalogue.QUERIES["j7_trend_table"](spark, FOLDER).explain("formatted")
    text = capsys.readouterr().out
    assert "o_custkey" not in text and "partial_avg" in text and "Python" not in text.split("Union")[0]
