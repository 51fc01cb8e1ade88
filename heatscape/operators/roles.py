"""Column profile, role inference and table routing.

A table's profile has one row per column.  All rules are expressions over the
profile; only the finished role map, one small row per column, is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatscape.functions.columns import as_double
from heatscape.functions.naming import TREND_NAME, YEAR_COLUMN, classify
from heatscape.functions.ranking import column_quantiles

PROFILE_SCHEMA = ("table string, position int, column string, numeric boolean, n bigint, "
                  "n_valid bigint, min double, max double, max_abs double, median double")
# Plausible medians of a temperature column, Celsius and Kelvin.
CELSIUS_RANGE = (10.0, 60.0)
KELVIN_RANGE = (270.0, 340.0)
MIN_TARGET_VALUES = 10
COORDINATE_LIMIT = {"lat": 90.0, "lon": 180.0}


@dataclass(frozen=True)
class RoleMap:
    table: str = ""
    n_rows: int = 0
    lst: str | None = None
    lat: str | None = None
    lon: str | None = None
    year: str | None = None
    zone: str | None = None
    indices: dict = field(default_factory=dict)
    extras: tuple = ()
    dropped: tuple = ()
    target_like: tuple = ()

    def features(self, keep_target_like: bool = True) -> list[str]:
        """Predictors: indices first, then the other numeric columns."""
        skip = () if keep_target_like else self.target_like
        return [c for c in [*self.indices.values(), *self.extras] if c not in skip]

    def without(self, columns) -> "RoleMap":
        gone = set(columns)
        return replace(self, indices={k: v for k, v in self.indices.items() if v not in gone},
                       extras=tuple(c for c in self.extras if c not in gone))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) or isinstance(f.dataType, T.BooleanType)]


def column_profile(df: DataFrame, table: str = "", medians: bool = True) -> DataFrame:
    """One row per column, from one fused aggregate (plus one for the medians)."""
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}"), F.max(F.abs(v)).alias(f"am{i}")]
    r = df.agg(*aggs).first()
    mid = {}
    if medians:
        mid = column_quantiles(df.select(*[as_double(df, c).alias(c) for c in df.columns if c in numeric]),
                               {c: [0.5] for c in df.columns if c in numeric})
    rows = [(table, i, c, c in numeric, r["n"], r[f"c{i}"], r[f"lo{i}"], r[f"hi{i}"], r[f"am{i}"],
             (mid.get(c) or [None])[0]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def assign_roles(profile: DataFrame, specific_first: bool = False) -> DataFrame:
    """Profile rows with their final ``role`` and ``canonical`` name.

    Roles: lst, lat, lon, year, zone, index, extra (other numeric), dropped.
    """
    d = classify(profile, "column", "__c", specific_first)
    # dates, times, bytes and nested values hold no number: they are no target, coordinate or index whatever their name
    empty = ~F.col("numeric") & (F.col("n") > 0) & (F.col("n_valid") == 0) & F.col("__c.role").isin("lst", "lat", "lon", "index")
    d = d.select(*profile.columns, F.when(empty, "other").otherwise(F.col("__c.role")).alias("named"),
                 F.when(~empty, F.col("__c.canonical")).alias("canonical"))
    first = F.row_number().over(W.partitionBy("table", "named", "canonical").orderBy("position")) == 1
    spare = F.when(F.col("numeric"), "extra").otherwise("dropped")
    role = (F.when(F.col("named") == "id", "dropped")
            .when(F.col("named") == "other", spare)
            .when(first, F.col("named")).otherwise(spare))
    d = d.withColumn("role", role)
    # no column named like the target: take the first whose median is a temperature
    whole = W.partitionBy("table")
    has_target = F.max(F.when(F.col("role") == "lst", 1).otherwise(0)).over(whole) == 1
    fits = (F.col("numeric") & ~F.col("role").isin("index", "lat", "lon", "year")
            & (F.col("n_valid") >= MIN_TARGET_VALUES)
            & (F.col("median").between(*CELSIUS_RANGE) | F.col("median").between(*KELVIN_RANGE)))
    chosen = F.min(F.when(fits, F.col("position"))).over(whole)
    d = d.withColumn("role", F.when(~has_target & (F.col("position") == chosen), "lst").otherwise(F.col("role")))
    for axis, limit in COORDINATE_LIMIT.items():
        bad = (F.col("role") == axis) & ((F.col("min") < -limit) | (F.col("max") > limit))
        d = d.withColumn("role", F.when(bad, "extra").otherwise(F.col("role")))
    return d


def role_map(assigned: DataFrame, table: str = "") -> RoleMap:
    rows = sorted(assigned.where(F.col("table") == table).collect(), key=lambda r: r["position"])
    one = {role: next((r["column"] for r in rows if r["role"] == role), None)
           for role in ("lst", "lat", "lon", "year", "zone")}
    extra = [r for r in rows if r["role"] == "extra"]
    # demoted coordinates come after the other extra columns
    extra.sort(key=lambda r: (r["max_abs"] or 0.0) > COORDINATE_LIMIT.get(r["named"], float("inf")))
    return RoleMap(
        table=table, n_rows=rows[0]["n"] if rows else 0,
        indices={r["canonical"]: r["column"] for r in rows if r["role"] == "index"},
        extras=tuple(r["column"] for r in extra),
        dropped=tuple(r["column"] for r in rows if r["role"] == "dropped"),
        target_like=tuple(r["column"] for r in extra if r["named"] == "lst"), **one)


def infer_roles(df: DataFrame, table: str = "", specific_first: bool = False) -> RoleMap:
    """Role map of one table; medians are read only when no name fits the target."""
    quick = role_map(assign_roles(column_profile(df, table, medians=False), specific_first), table)
    if quick.lst is not None:
        return quick
    return role_map(assign_roles(column_profile(df, table), specific_first), table)


def role_report(assigned: DataFrame) -> DataFrame:
    """One row per table: size, target, coordinates, indices and extra columns."""
    def one(role):
        return F.max(F.when(F.col("role") == role, F.col("column")))

    def names(role, what):
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col(what)))), ", ")

    return assigned.groupBy("table").agg(
        F.max("n").alias("n_rows"), one("lst").alias("target"), one("lat").alias("lat"),
        one("lon").alias("lon"), one("year").alias("year"), one("zone").alias("zone"),
        F.count_if(F.col("role") == "index").alias("n_indices"),
        names("index", "canonical").alias("indices"), names("extra", "column").alias("extra_numeric"))


def table_routes(profile: DataFrame) -> DataFrame:
    """Tables named like a time series, or with three year-named columns, go to trends."""
    years = F.count_if(F.trim("column").rlike(f"^{YEAR_COLUMN}$"))
    return profile.groupBy("table").agg(years.alias("n_year_columns")).withColumn(
        "route", F.when(F.lower("table").rlike(TREND_NAME) | (F.col("n_year_columns") >= 3), "trend")
        .otherwise("cross"))


def is_trend_table(name: str, df: DataFrame) -> bool:
    rows = [(name, i, c) for i, c in enumerate(df.columns)]
    profile = df.sparkSession.createDataFrame(rows, "table string, position int, column string")
    return table_routes(profile).first()["route"] == "trend"


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of every input."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out
