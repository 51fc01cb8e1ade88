"""Land-cover area tables with a title, a blank row and two header rows."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_area_table(spark: SparkSession, path: str, zone: str) -> DataFrame:
    """``zone, year, index, class, area_km2`` from one two-level-header file.

    The first header row names each index group in its first cell, the second
    one the classes; only these two rows reach the driver.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"))
    groups = lines.where(F.lower("value").startswith("year,")).first()["value"]
    classes = lines.where(F.col("value").rlike("^,.*[A-Za-z]")).first()["value"]
    groups, classes = next(csv.reader([groups])), next(csv.reader([classes]))
    labels, current = [], ""
    for g, c in list(zip(groups, classes))[1:]:
        current = g.strip() or current
        labels.append((current, c.strip()))
    data = lines.where(F.col("value").rlike(r"^\d{4},")).select(F.split("value", ",").alias("v"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(g).alias("index"), F.lit(c).alias("class"),
                 F.element_at("v", i + 2).try_cast("double").alias("area_km2"))
        for i, (g, c) in enumerate(labels)]))
    return data.select(F.lit(zone).alias("zone"), F.element_at("v", 1).cast("int").alias("year"),
                       cells.alias("c")).select("zone", "year", "c.*")


def area_shares(areas: DataFrame) -> DataFrame:
    """Share of each class in its zone, year and index."""
    total = F.sum("area_km2").over(W.partitionBy("zone", "year", "index"))
    return areas.withColumn("share", F.col("area_km2") / total)


def epoch_change(areas: DataFrame) -> DataFrame:
    """Area difference from the previous epoch of the same class."""
    w = W.partitionBy("zone", "index", "class").orderBy("year")
    return areas.withColumn("delta_km2", F.col("area_km2") - F.lag("area_km2").over(w))
