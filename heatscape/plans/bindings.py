"""The driver's tables in the roles of an analysis, as DataFrames and as SQL.

observations  lineitem, with no-data codes, text cells and mixed units
pixels        embeddings: two coordinates, six predictors, a target, a zone
readings      events: hour of day and root of the value as coordinates
series        orders: yearly total price per priority
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.functions.columns import HASH_RANGE, hash_bucket

FEATURES = ["f2", "f3", "f4", "f5", "f6", "f7"]

OBSERVATIONS = """
observations AS (
  SELECT CASE WHEN l_quantity = 1 THEN NULL ELSE 288.15 + l_extendedprice / 3500.0 END AS LST_Celsius,
         CASE WHEN l_discount = 0.05 THEN NULL ELSE l_discount * 10000.0 END AS ndvi_mean,
         CASE WHEN l_tax = 0.08 THEN 'n/a' ELSE CAST(l_tax AS VARCHAR) END AS surface_albedo,
         l_quantity * 10.0 AS elev,
         CAST(1.0 AS DOUBLE) AS urban_index,
         CASE WHEN l_discount = 0.1 AND l_tax = 0.08 AND l_quantity > 45 THEN l_quantity / 50.0 END AS savi_mean,
         CAST(l_suppkey AS DOUBLE) AS humidity,
         l_returnflag AS Ward_Name
  FROM lineitem)"""


def observations(t) -> DataFrame:
    d = t.lineitem
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return d.select(
        F.when(q != 1, F.lit(288.15) + F.col("l_extendedprice") / 3500.0).alias("LST_Celsius"),
        F.when(disc != 0.05, disc * 10000.0).alias("ndvi_mean"),
        F.when(tax == 0.08, "n/a").otherwise(tax.cast("string")).alias("surface_albedo"),
        (q * 10.0).alias("elev"), F.lit(1.0).alias("urban_index"),
        F.when((disc == 0.1) & (tax == 0.08) & (q > 45), q / 50.0).alias("savi_mean"),
        F.col("l_suppkey").cast("double").alias("humidity"), F.col("l_returnflag").alias("Ward_Name"))


PIXELS = """
pixels AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS lon, CAST(embedding[2] AS DOUBLE) AS lat,
         CAST(embedding[3] AS DOUBLE) AS f2, CAST(embedding[4] AS DOUBLE) AS f3,
         CAST(embedding[5] AS DOUBLE) AS f4, CAST(embedding[6] AS DOUBLE) AS f5,
         CAST(embedding[7] AS DOUBLE) AS f6, CAST(embedding[8] AS DOUBLE) AS f7,
         30.0 + 10.0 * CAST(embedding[3] AS DOUBLE) - 6.0 * CAST(embedding[4] AS DOUBLE)
              + 2.0 * CAST(embedding[9] AS DOUBLE) AS y,
         label AS zone
  FROM embeddings)"""


def pixels(t) -> DataFrame:
    def e(i):
        return F.col("embedding")[i].cast("double")
    return t.embeddings.select(
        F.col("vec_id").alias("id"), e(0).alias("lon"), e(1).alias("lat"),
        *[e(i).alias(f"f{i}") for i in range(2, 8)],
        (F.lit(30.0) + e(2) * 10.0 - e(3) * 6.0 + e(8) * 2.0).alias("y"), F.col("label").alias("zone"))


READINGS = """
readings AS (
  SELECT event_id AS id, CAST(epoch_us(ts) % 86400000000 AS DOUBLE) / 3600000000.0 AS lon,
         sqrt("value") AS lat, "value" AS v, event_type AS unit
  FROM events)"""


def readings(t) -> DataFrame:
    seconds = F.expr("(hour(ts) * 3600 + minute(ts) * 60) * 1000000L + "
                     "cast(extract(SECOND FROM ts) * 1000000 AS bigint)")
    return t.events.select(
        F.col("event_id").alias("id"), (seconds.cast("double") / 3600000000.0).alias("lon"),
        F.sqrt("value").alias("lat"), F.col("value").alias("v"), F.col("event_type").alias("unit"))


SERIES = """
series AS (
  SELECT o_orderpriority AS unit, CAST(year(o_orderdate) AS INTEGER) AS "year", o_totalprice AS "value"
  FROM orders)"""


def series(t) -> DataFrame:
    return t.orders.select(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").alias("year"),
                           F.col("o_totalprice").alias("value"))


def hash_sql(key: str, seed: int = 0) -> str:
    m = HASH_RANGE
    return f"(((({key} % {m}) + {m}) % {m}) * 1103515245 + {12345 + seed}) % {m}"


def bucket_sql(key: str, n: int, seed: int = 0) -> str:
    return f"CAST(({hash_sql(key, seed)}) * {n} // {HASH_RANGE} AS INTEGER)"


def distance2_sql(a: str, b: str, cols) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def ols2_sql(source: str, name: str = "model", x1: str = "f2", x2: str = "f3", y: str = "y", group: str = "") -> str:
    """CTE with intercept b0 and slopes b1, b2 of a two-feature least squares fit."""
    g, by = (f"{group} AS {group.split('.')[-1]}, ", f" GROUP BY {group}") if group else ("", "")
    out = f"{group.split('.')[-1]}, " if group else ""
    return f"""
{name} AS (
  SELECT {out}n, my - b1 * m1 - b2 * m2 AS b0, b1, b2, m1, m2, my, s11, s22, s12, syy, s1y, s2y FROM (
    SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
              (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
      SELECT {g}count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my, var_pop({x1}) AS s11,
             var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12, var_pop({y}) AS syy,
             covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y
      FROM {source}{by}) AS sums) AS slopes)"""


def parted(t) -> DataFrame:
    """Pixels with ``part``: one fifth test, two calibrate, two train."""
    b = hash_bucket("id", 5)
    return pixels(t).withColumn("part", F.when(b == 0, "test").when(b <= 2, "calibrate").otherwise("train"))


PARTED = f"""{PIXELS},
parted AS (
  SELECT *, CASE WHEN bucket = 0 THEN 'test' WHEN bucket <= 2 THEN 'calibrate' ELSE 'train' END AS part
  FROM (SELECT *, {bucket_sql('id', 5)} AS bucket FROM pixels) AS b)"""
