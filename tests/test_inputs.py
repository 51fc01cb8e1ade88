"""Inputs with duplicate predictors and with columns that hold no numbers."""

import numpy as np
from pyspark.sql import functions as F

from heatscape.functions.columns import as_double
from heatscape.operators import roles
from heatscape.operators.collinearity import INFINITE_VIF, screen, vif_from_correlation
from heatscape.sources.tables import _header_names

FOLDER = "/root/testdata/sf0.001"


def test_only_twins_are_infinite():
    r = np.array([[1.0, 0.2, 0.2], [0.2, 1.0, 1.0], [0.2, 1.0, 1.0]])
    v = vif_from_correlation(r)
    assert v[1] == v[2] == INFINITE_VIF and abs(v[0] - 1 / (1 - 0.04)) < 1e-9
    kept, history = screen(r, ["a", "b", "c"])
    assert kept == ["a", "c"] and history == [("b", INFINITE_VIF, "removed")]


def test_regular_matrix_as_before():
    r = np.array([[1.0, 0.5, 0.1], [0.5, 1.0, 0.3], [0.1, 0.3, 1.0]])
    assert np.allclose(vif_from_correlation(r), np.diag(np.linalg.inv(r)))


def test_dates_and_nested_columns_are_no_numbers(spark):
    df = spark.sql("SELECT DATE'2020-01-02' AS d, TIMESTAMP_NTZ'2020-01-02 03:04:05' AS n, current_timestamp() AS t, array(1) AS a, "
                   "struct(1 AS x) AS s, X'01' AS b, true AS f, '2.5' AS w, 3 AS i")
    row = df.select(*[as_double(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == (None, None, None, None, None, None, 1.0, 2.5, 3.0)


def test_roles_of_tables_as_they_are(spark):
    for name in ("orders", "events", "embeddings"):
        table = spark.read.parquet(f"{FOLDER}/{name}.parquet").withColumn("observed", F.current_date())
        assert roles.infer_roles(table, name) is not None


def test_quoted_header_names():
    assert _header_names('"LST, mean",NDVI, "a ""b""",', ",") == ["LST, mean", "NDVI", 'a "b"', "Unnamed_3"]
