"""Yearly trends: Mann-Kendall test, Sen slope and period summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatscape.functions import series as S
from heatscape.functions.columns import as_double, two_sided_p
from heatscape.functions.naming import LST_PATTERN, YEAR_COLUMN, normalise
from heatscape.operators.roles import infer_roles, numeric_columns

MIN_YEARS = 5
ALPHA = 0.05


def wide_to_long(df: DataFrame) -> DataFrame:
    """Year-named columns become rows; the first other column names the unit."""
    years = [c for c in df.columns if re.fullmatch(YEAR_COLUMN, c.strip())]
    others = [c for c in df.columns if c not in years]
    unit = F.col(f"`{others[0]}`").cast("string") if others else F.lit("ALL")
    d = df.select(unit.alias("unit"), *[as_double(df, c).alias(c) for c in years])
    return (d.unpivot("unit", years, "year", "value")
            .select("unit", F.trim("year").cast("int").alias("year"), "value").dropna())


def as_year(df: DataFrame, name: str) -> Column:
    """The year of a numeric, text or date column."""
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(F.col(f"`{name}`"))
    return as_double(df, name).cast("int")


def by_roles(df: DataFrame, year: str, value: str, zone: str | None = None) -> DataFrame:
    unit = F.col(f"`{zone}`").cast("string") if zone else F.lit("ALL")
    return df.select(unit.alias("unit"), as_year(df, year).alias("year"),
                     as_double(df, value).alias("value")).dropna()


def detect_year_column(df: DataFrame) -> str | None:
    """First column whose numeric values or dates (more than three) all lie in 1980..2035."""
    aggs = []
    for i, c in enumerate(df.columns):
        v = as_year(df, c) if isinstance(df.schema[c].dataType, T.DatetimeType) else as_double(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    r = df.agg(*aggs).first()
    for i, c in enumerate(df.columns):
        if r[f"n{i}"] > 3 and r[f"lo{i}"] >= 1980 and r[f"hi{i}"] <= 2035:
            return c
    return None


def tidy(df: DataFrame, value_col: str | None = None) -> DataFrame | None:
    """Any trend table as ``unit, year, value``; None when there is no time axis."""
    if any(re.fullmatch(YEAR_COLUMN, c.strip()) for c in df.columns):
        return wide_to_long(df)
    roles = infer_roles(df, "trend")
    value = value_col or roles.lst
    if roles.year and value:
        return by_roles(df, roles.year, value, roles.zone)
    year = detect_year_column(df)
    if year is None:
        return None
    numeric = [c for c in numeric_columns(df) if c != year]
    named = [c for c in numeric if re.search(LST_PATTERN, normalise(c))]
    value = value_col or (named or numeric or [None])[0]
    return None if value is None else by_roles(df, year, value)


def yearly_means(long: DataFrame, keys: list[str] = ("unit",)) -> DataFrame:
    return long.groupBy(*keys, "year").agg(F.avg("value").alias("value"))


def _arrays(long: DataFrame, keys: list[str]) -> DataFrame:
    # Means are combined before the shuffle, so a hot unit sends one row per
    # year and task; the array then holds one entry per distinct year.
    pairs = F.sort_array(F.collect_list(F.struct("year", "value")))
    return (yearly_means(long, keys).groupBy(*keys).agg(pairs.alias("p"))
            .where(F.size("p") >= MIN_YEARS)
            .select(*keys, F.col("p.year").alias("years"), F.col("p.value").alias("v")))


def pair_statistics(long: DataFrame, keys: list[str] = ("unit",),
                    pairwise_limit: int = S.PAIRWISE_LIMIT) -> DataFrame:
    """Per series: years, values, S, tie term and Sen slope."""
    keys = list(keys)
    base = _arrays(long, keys)
    v = F.col("v")
    short = base.where(F.size(v) <= pairwise_limit).select(
        "*", S.kendall_s(v).alias("s"), S.tie_term(v).alias("ties"), S.sen_slope(v).alias("slope"))
    many = base.where(F.size(v) > pairwise_limit).withColumn("__r", S.long_series("v")).select(
        *keys, "years", "v", "__r.s", "__r.ties", "__r.slope")
    return short.unionByName(many)


def mann_kendall(long: DataFrame, keys: list[str] = ("unit",), **kw) -> DataFrame:
    """S, tau, z, two-sided p and the verdict at the 5 % level for each series."""
    n = F.size("v").cast("double")
    var = (n * (n - 1.0) * (2.0 * n + 5.0) - F.col("ties")) / 18.0
    z = F.when(F.col("s") > 0, (F.col("s") - 1.0) / F.sqrt(var)).when(
        F.col("s") < 0, (F.col("s") + 1.0) / F.sqrt(var)).otherwise(0.0)
    d = pair_statistics(long, keys, **kw).withColumn("z", z)
    d = d.withColumn("p", two_sided_p(F.col("z"))).withColumn(
        "tau", F.col("s") / (0.5 * n * (n - 1.0)))
    return d.withColumn("trend", F.when((F.col("p") < ALPHA) & (F.col("z") > 0), "increasing")
                        .when((F.col("p") < ALPHA) & (F.col("z") < 0), "decreasing")
                        .otherwise("no trend"))


def trend_table(long: DataFrame, zone: str | None = None, **kw) -> DataFrame:
    """One row per series; ``long`` may carry its own ``zone`` column."""
    if "zone" not in long.columns:
        long = long.withColumn("zone", F.lit(zone or "Unassigned"))
    d = mann_kendall(long, ["zone", "unit"], **kw)
    n = F.size("v")
    third = F.greatest(F.lit(1), F.floor(n / 3).cast("int"))

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a)

    first, last = F.element_at("years", 1), F.element_at("years", -1)
    step = (last - first) / (n - 1)
    return d.select(
        F.col("zone").alias("Zone"), F.col("unit").alias("Unit"),
        F.concat_ws("-", first.cast("string"), last.cast("string")).alias("Years"),
        n.cast("bigint").alias("N_obs"), F.col("trend").alias("Trend"),
        F.col("p").alias("MK_p"), F.col("tau").alias("MK_tau"),
        F.col("slope").alias("Sen_slope_per_step"),
        F.when(step != 0, F.col("slope") * 10.0 / step).alias("Sen_slope_per_decade"),
        (F.col("slope") * (n - 1)).alias("Total_change_C"),
        mean(F.col("v")).alias("Mean_LST"),
        mean(F.slice("v", 1, third)).alias("First_period_mean"),
        mean(F.slice("v", n - third + 1, third)).alias("Last_period_mean"))


def significant_series(trends: DataFrame) -> DataFrame:
    return trends.agg(F.count(F.lit(1)).alias("n_series"),
                      F.count_if(F.col("MK_p") < ALPHA).alias("n_significant"))
