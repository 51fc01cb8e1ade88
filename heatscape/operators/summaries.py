"""Tables behind the figures and the written report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.functions.ranking import global_rank, quantiles
from heatscape.operators.trend import yearly_means

CHUNK = 32_768


def _ordered(df: DataFrame, by: list[str], x: str, key: str) -> DataFrame:
    return global_rank(df, [x, key], by, out="r")


def rolling_mean(df: DataFrame, x: str, value: str, key: str, by: list[str] = (), share: int = 25,
                 min_width: int = 5) -> DataFrame:
    """Centred rolling mean of ``value`` along ``x``, window max(5, n // 25), cut at the ends.

    The window grows with the table, so it is taken as a difference of running
    sums: sums inside chunks of fixed size plus the sums of earlier chunks.
    """
    by = list(by)
    d = _ordered(df.select(*by, x, value, key), by, x, key)
    d = d.withColumn("chunk", F.floor(F.col("r") / CHUNK))
    inside = W.partitionBy(*by, "chunk").orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    chunks = d.groupBy(*by, "chunk").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    earlier = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row per chunk
    chunks = chunks.select(
        *by, "chunk",
        F.coalesce(F.sum("s").over(earlier.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        .alias("before"), F.sum("c").over(earlier).alias("n"))
    d = d.join(chunks, [*by, "chunk"]).withColumn("run", F.col("before") + F.sum(value).over(inside))
    w = F.greatest(F.lit(min_width), F.floor(F.col("n") / share))
    first = F.greatest(F.lit(0), F.col("r") - F.floor(w / 2))
    last = F.least(F.col("n") - 1, F.col("r") + F.floor((w - 1) / 2))
    d = d.withColumns({"first": first.cast("long"), "last": last.cast("long")})
    sums = d.select(*by, "r", "run")
    upper = sums.withColumnsRenamed({"r": "last", "run": "upper"})
    lower = sums.select(*by, (F.col("r") + 1).alias("first"), F.col("run").alias("lower"))
    d = d.join(upper, [*by, "last"]).join(lower, [*by, "first"], "left")
    mean = (F.col("upper") - F.coalesce("lower", F.lit(0.0))) / (F.col("last") - F.col("first") + 1)
    return d.select(*by, key, x, value, F.col("r").alias("position"), mean.alias("smooth"))


def percentile_rank(df: DataFrame, x: str, key: str, by: list[str] = ()) -> DataFrame:
    """Place of each row along ``x`` from 0 to 1; ties follow the key."""
    by = list(by)
    d = _ordered(df, by, x, key)
    if by:
        d = d.join(d.groupBy(*by).agg(F.max("r").alias("top")), by)
    else:
        d = d.withColumn("top", F.lit(d.agg(F.max("r")).first()[0]))
    return d.select(*df.columns, (F.col("r") / F.greatest(F.lit(1), F.col("top"))).alias("percentile"))


def histogram(df: DataFrame, value: str, bins: int = 36) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum falls into the last one."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, width = r["lo"], (r["hi"] - r["lo"]) if r["lo"] is not None else None
    at = F.least(F.floor((F.col(value) - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)) if width else F.lit(0)
    return (df.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles and the last values within 1.5 quartile ranges."""
    by = list(by)
    q = quantiles(df, value, [0.25, 0.5, 0.75], by).select(
        *by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return df.select(*by, value).join(q, by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"))


def yearly_line(long: DataFrame, by: list[str] = ("unit",)) -> DataFrame:
    """Least-squares line through the yearly means."""
    return yearly_means(long, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_years"), F.regr_slope("value", "year").alias("slope"),
        F.regr_intercept("value", "year").alias("intercept"))


def steepest_series(trends: DataFrame, n: int = 14) -> DataFrame:
    """Series of largest change per decade with a short label and a significance flag."""
    zone = F.trim(F.regexp_replace("Zone", r"\(.*?\)", ""))
    label = F.substring(F.concat(zone, F.lit(" · "), F.col("Unit")), 1, 26)
    return (trends.select(label.alias("label"), "Sen_slope_per_decade", (F.col("MK_p") < 0.05).alias("significant"))
            .orderBy(F.desc("Sen_slope_per_decade"), "label").limit(n))


def top_features(imp: DataFrame, n: int = 10) -> DataFrame:
    """Strongest features of each zone."""
    w = W.partitionBy("Zone").orderBy(F.desc("MeanAbsSHAP"), "Feature")
    return imp.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def dominant_drivers(imp: DataFrame, n: int = 2) -> DataFrame:
    """Leading warming and cooling features of each zone as text."""
    w = W.partitionBy("Zone", "Direction").orderBy(F.desc("MeanAbsSHAP"), "Feature")
    d = imp.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)

    def names(direction):
        got = F.sort_array(F.collect_list(F.when(F.col("Direction") == direction, F.struct("place", "Feature"))))
        return F.array_join(F.transform(got, lambda s: s["Feature"]), ", ")
    return d.groupBy("Zone").agg(names("warming").alias("warming"), names("cooling").alias("cooling"))


def report_rollup(bench: DataFrame, audit: DataFrame, trends: DataFrame, drivers: DataFrame) -> DataFrame:
    """The report's numbers as ``item, name, value`` rows."""
    best = bench.groupBy("Zone").agg(F.max_by("Model", "R2").alias("m"), F.max("R2").alias("r"))
    return (best.select(F.lit("best_model").alias("item"), F.concat_ws(": ", "Zone", "m").alias("name"),
                        F.col("r").alias("value"))
            .unionByName(audit.agg(F.avg("optimism").alias("value")).select(
                F.lit("mean_optimism").alias("item"), F.lit("all").alias("name"), "value"))
            .unionByName(trends.agg(F.count_if(F.col("MK_p") < 0.05).cast("double").alias("value")).select(
                F.lit("significant_series").alias("item"), F.lit("all").alias("name"), "value"))
            .unionByName(drivers.where("Non_stationary").groupBy(F.col("Zone").alias("name")).agg(
                F.count(F.lit(1)).cast("double").alias("value")).select(
                F.lit("non_stationary_drivers").alias("item"), "name", "value")))
