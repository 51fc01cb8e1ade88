from pyspark.sql import functions as F

from heatscape.functions.columns import unit_hash
from heatscape.operators import gatekeeper, linear


def test_row_without_a_feature_is_rejected_not_lost(spark):
    d = spark.range(600).select("id", unit_hash("id", 1).alias("a"), unit_hash("id", 2).alias("b"))
    d = d.withColumn("y", F.col("a") * 3 - F.col("b") + unit_hash("id", 3) * 0.1)
    part = F.col("id") % 3
    train, cal = d.where(part == 0), d.where(part == 1)
    test = d.where(part == 2).withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    gate = gatekeeper.Gatekeeper("id", ("a", "b")).fit(linear.fit_ols(train, ["a", "b"], "y"), cal, train, "y")
    rows = {r["id"]: r for r in gate.score(test).collect()}
    assert len(rows) == 200
    assert rows[5]["verdict"] == "REJECT" and rows[5]["trust_score"] is None and rows[5]["lower"] is None
    assert all(r["trust_score"] is not None for i, r in rows.items() if i != 5)
