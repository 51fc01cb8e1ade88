"""Scans, sinks, role inference and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.functions import naming
from heatscape.functions.columns import split_hash
from heatscape.operators import clean as C
from heatscape.operators import roles as R
from heatscape.operators.pooling import pool
from heatscape.plans.bindings import OBSERVATIONS, hash_sql, observations
from heatscape.plans.registry import query
from heatscape.session import scratch_folder, spread
from heatscape.sources import area_table, sinks, tables

# ---- scans and sinks -------------------------------------------------------

ORDER_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
ORDER_SQL = """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, sum(o_totalprice) AS total
FROM orders GROUP BY o_orderstatus"""


def order_summary(d: DataFrame) -> DataFrame:
    return d.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"),
                                          F.sum("o_totalprice").alias("total"))


def _orders(t) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("a1_csv_scan", "o_orderstatus n n_customers", "total", ORDER_SQL, dp=2)
def a1(t):
    path = scratch_folder(t.spark)
    sinks.write_table(_orders(t), path)
    return order_summary(tables.read_csv(t.spark, path, ORDER_COLUMNS))


@query("a2_tsv_scan", "o_orderstatus n n_customers", "total", ORDER_SQL, dp=2)
def a2(t):
    path = scratch_folder(t.spark)
    _orders(t).write.option("header", True).option("sep", "\t").csv(path)
    return order_summary(tables.read_tsv(t.spark, path))


@query("a3_parquet_scan", "o_orderstatus n n_customers", "total", ORDER_SQL, dp=2)
def a3(t):
    return order_summary(tables.read_parquet(t.spark, f"{t.folder}/orders.parquet"))


SHAPES = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11,
          "events": 6, "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}
SHAPE_SQL = "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS n_rows, CAST({n} AS BIGINT) AS n_columns FROM {name}"
    for name, n in SHAPES.items())


@query("a4_discover_inputs", "table n_rows n_columns", sql=SHAPE_SQL.replace('AS "table"', 'AS "table"'))
def a4(t):
    return R.table_profile(tables.discover_inputs(t.spark, t.folder))


AREAS_SQL = """
WITH areas AS (
  SELECT o_orderstatus AS zone, CAST(year(o_orderdate) AS INTEGER) AS "year", o_orderpriority AS class,
         sum(o_totalprice) / 1000000.0 AS area_km2
  FROM orders GROUP BY 1, 2, 3)
SELECT zone, "year", class, area_km2, area_km2 / sum(area_km2) OVER (PARTITION BY zone, "year") AS share,
       area_km2 - lag(area_km2) OVER (PARTITION BY zone, class ORDER BY "year") AS delta_km2
FROM areas"""


@query("a6_area_shares", "zone year class", "area_km2 share delta_km2", AREAS_SQL)
def a6(t):
    d = t.orders.groupBy(F.col("o_orderstatus").alias("zone"), F.year("o_orderdate").alias("year"),
                         F.lit("PRIORITY").alias("index"), F.col("o_orderpriority").alias("class")).agg(
        (F.sum("o_totalprice") / 1000000.0).alias("area_km2"))
    return area_table.epoch_change(area_table.area_shares(d))


@query("a7_result_sink", "Zone n", "total", """
SELECT o_orderstatus AS "Zone", count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1""", dp=2)
def a7(t):
    path = scratch_folder(t.spark)
    rows = _orders(t).withColumnRenamed("o_orderstatus", "Zone")
    done = sinks.write_results({"temporal_trends": rows}, path, fmt="parquet")
    return t.spark.read.parquet(done[0]).groupBy("Zone").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("a8_table_profile", "table n_rows n_columns", sql=SHAPE_SQL)
def a8(t):
    return R.table_profile({name: getattr(t, name) for name in SHAPES})


# ---- names and roles -------------------------------------------------------

NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query("b1_normalise_names", "normal n_names n_rows", sql=f"""
SELECT normal, count(DISTINCT name) AS n_names, count(*) AS n_rows FROM (
  SELECT name, {NORM.format('name')} AS normal FROM (
    SELECT p_brand AS name FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_name FROM part
    UNION ALL SELECT url FROM pages) AS names) AS normals
GROUP BY normal""")
def b1(t):
    names = t.part.select(F.explode(F.array("p_brand", "p_type", "p_name")).alias("name")).unionByName(
        t.pages.select(F.col("url").alias("name")))
    # few rows per name are left before distinct names are counted
    per_name = names.groupBy("name").count()
    return per_name.groupBy(naming.normalised(F.col("name")).alias("normal")).agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("count").alias("n_rows"))


def role_case(what: str, column: str = "name") -> str:
    """SQL CASE giving the role or the canonical name of a column name."""
    n = NORM.format(column)

    def hit(pattern, text):
        return f"regexp_matches({text}, '{pattern}')"

    def pick(role, canonical):
        value = role if what == "role" else canonical
        return "NULL" if value is None else f"'{value}'"

    low = f"lower({column})"
    arms = [(f"{hit(naming.ID_PATTERN, n)} OR {hit(naming.ID_PATTERN, low)}", pick("id", None)),
            (hit(naming.YEAR_PATTERN, n), pick("year", "YEAR")), (hit(naming.LAT_PATTERN, n), pick("lat", "LAT")),
            (hit(naming.LON_PATTERN, n), pick("lon", "LON"))]
    arms += [(hit(p, n), pick("index", c)) for c, p in naming.INDEX_PATTERNS.items()]
    arms += [(hit(naming.LST_PATTERN, n), pick("lst", "LST")), (hit(naming.ZONE_PATTERN, n), pick("zone", "ZONE"))]
    body = "\n    ".join(f"WHEN {cond} THEN {value}" for cond, value in arms)
    return f"CASE {body}\n    ELSE {pick('other', None)} END"


WORDS_SQL = """
words AS (
  SELECT name, count(*) AS n FROM (
    SELECT unnest(string_split_regex(lower("text"), '[^a-z0-9]+')) AS name FROM documents) AS w
  WHERE name <> '' GROUP BY name)"""


def document_words(t) -> DataFrame:
    """Distinct words of the whole texts with their counts."""
    return (spread(t.documents).select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("name"))
            .where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")))


@query("b2_classify_names", "role canonical n_names n_rows", sql=f"""
WITH {WORDS_SQL}
SELECT role, canonical, count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT {role_case('role')} AS role, {role_case('canonical')} AS canonical, n FROM words) AS c
GROUP BY role, canonical""")
def b2(t):
    c = naming.classify(document_words(t), "name").groupBy("named").agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_rows"))
    return c.select("named.*", "n_names", "n_rows")


STATIONS = """
stations AS (
  SELECT c_custkey AS id, c_acctbal AS latitude, CAST(c_nationkey AS DOUBLE) AS longitude,
         20.0 + c_acctbal / 1000.0 AS reading, CAST(c_custkey AS DOUBLE) / 10.0 AS counter,
         c_mktsegment AS segment, c_name AS station_name
  FROM customer)"""
SCENES = """
scenes AS (
  SELECT o_orderkey AS objectid, o_totalprice AS LST_mean, o_totalprice * 2.0 AS LST_max,
         CAST(year(o_orderdate) AS INTEGER) AS "year", CAST(o_custkey AS DOUBLE) / 1000000.0 AS NDBI,
         o_orderpriority AS ward, o_orderstatus AS flag
  FROM orders)"""
PROFILED = {
    "observations": [("LST_Celsius", 1), ("ndvi_mean", 1), ("surface_albedo", 0), ("elev", 1), ("urban_index", 1),
                     ("savi_mean", 1), ("humidity", 1), ("Ward_Name", 0)],
    "stations": [("id", 1), ("latitude", 1), ("longitude", 1), ("reading", 1), ("counter", 1), ("segment", 0),
                 ("station_name", 0)],
    "scenes": [("objectid", 1), ("LST_mean", 1), ("LST_max", 1), ("year", 1), ("NDBI", 1), ("ward", 0), ("flag", 0)],
}


def stations(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("latitude"),
        F.col("c_nationkey").cast("double").alias("longitude"), (F.lit(20.0) + F.col("c_acctbal") / 1000.0).alias("reading"),
        (F.col("c_custkey").cast("double") / 10.0).alias("counter"), F.col("c_mktsegment").alias("segment"),
        F.col("c_name").alias("station_name"))


def scenes(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("objectid"), F.col("o_totalprice").alias("LST_mean"),
        (F.col("o_totalprice") * 2.0).alias("LST_max"), F.year("o_orderdate").alias("year"),
        (F.col("o_custkey").cast("double") / 1000000.0).alias("NDBI"), F.col("o_orderpriority").alias("ward"),
        F.col("o_orderstatus").alias("flag"))


def profile(t) -> DataFrame:
    return (R.column_profile(observations(t), "observations")
            .unionByName(R.column_profile(stations(t), "stations"))
            .unionByName(R.column_profile(scenes(t), "scenes")))


def _profile_sql() -> str:
    parts = []
    for table, cols in PROFILED.items():
        for i, (c, numeric) in enumerate(cols):
            v = f'TRY_CAST("{c}" AS DOUBLE)'
            med = f"quantile_cont({v}, 0.5)" if numeric else "CAST(NULL AS DOUBLE)"
            parts.append(
                f"SELECT '{table}' AS tbl, {i} AS pos, '{c}' AS name, {bool(numeric)} AS is_num, count(*) AS n, "
                f"count({v}) AS n_valid, min({v}) AS lo, max({v}) AS hi, max(abs({v})) AS amax, {med} AS med FROM {table}")
    return "profile AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


ROLES_SQL = f"""
WITH {OBSERVATIONS}, {STATIONS}, {SCENES}, {_profile_sql()},
named AS (SELECT *, {role_case('role')} AS named, {role_case('canonical')} AS canonical FROM profile),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY tbl, named, canonical ORDER BY pos) AS nth FROM named),
step1 AS (
  SELECT *, CASE WHEN named = 'id' THEN 'dropped'
                 WHEN named <> 'other' AND nth = 1 THEN named
                 WHEN is_num THEN 'extra' ELSE 'dropped' END AS r1 FROM firsts),
step2 AS (
  SELECT *, CASE WHEN max(CASE WHEN r1 = 'lst' THEN 1 ELSE 0 END) OVER (PARTITION BY tbl) = 0
                  AND pos = min(CASE WHEN is_num AND r1 NOT IN ('index', 'lat', 'lon', 'year') AND n_valid >= 10
                                      AND (med BETWEEN 10 AND 60 OR med BETWEEN 270 AND 340) THEN pos END)
                            OVER (PARTITION BY tbl) THEN 'lst' ELSE r1 END AS r2 FROM step1),
roles AS (
  SELECT *, CASE WHEN r2 = 'lat' AND (lo < -90 OR hi > 90) THEN 'extra'
                 WHEN r2 = 'lon' AND (lo < -180 OR hi > 180) THEN 'extra' ELSE r2 END AS role FROM step2)
"""


@query("b0_column_profile", "table position column numeric n n_valid", "min max max_abs median", f"""
WITH {OBSERVATIONS}, {STATIONS}, {SCENES}, {_profile_sql()}
SELECT tbl AS "table", pos AS position, name AS "column", is_num AS "numeric", n, n_valid, lo AS "min", hi AS "max",
       amax AS max_abs, med AS median FROM profile""")
def b0(t):
    return profile(t)


@query("b3_assign_roles", "table position column role canonical", sql=f"""{ROLES_SQL}
SELECT tbl AS "table", pos AS position, name AS "column", role, canonical FROM roles""")
def b3(t):
    return R.assign_roles(profile(t))


@query("b4_fallback_target", "table column", "median", sql=f"""{ROLES_SQL}
SELECT tbl AS "table", name AS "column", med AS median FROM roles WHERE role = 'lst' AND named <> 'lst'""")
def b4(t):
    return R.assign_roles(profile(t)).where("role = 'lst' AND named <> 'lst'")


@query("b5_coordinate_check", "table column axis kept", "min max", sql=f"""{ROLES_SQL}
SELECT tbl AS "table", name AS "column", named AS axis, role = named AS kept, lo AS "min", hi AS "max"
FROM roles WHERE named IN ('lat', 'lon')""")
def b5(t):
    return R.assign_roles(profile(t)).where("named IN ('lat', 'lon')").select(
        "table", "column", F.col("named").alias("axis"), (F.col("role") == F.col("named")).alias("kept"), "min", "max")


@query("b6_role_report", "table n_rows target lat lon year zone n_indices indices extra_numeric", sql=f"""{ROLES_SQL}
SELECT tbl AS "table", max(n) AS n_rows, max(CASE WHEN role = 'lst' THEN name END) AS target,
       max(CASE WHEN role = 'lat' THEN name END) AS lat, max(CASE WHEN role = 'lon' THEN name END) AS lon,
       max(CASE WHEN role = 'year' THEN name END) AS "year", max(CASE WHEN role = 'zone' THEN name END) AS zone,
       count(CASE WHEN role = 'index' THEN 1 END) AS n_indices,
       coalesce(string_agg(canonical, ', ' ORDER BY canonical) FILTER (WHERE role = 'index'), '') AS indices,
       coalesce(string_agg(name, ', ' ORDER BY name) FILTER (WHERE role = 'extra'), '') AS extra_numeric
FROM roles GROUP BY tbl""")
def b6(t):
    return R.role_report(R.assign_roles(profile(t)))


@query("b7_zone_label", "label n_names n_rows", sql=f"""
WITH {WORDS_SQL}
SELECT label, count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_rows FROM (
  SELECT n, CASE WHEN contains(name, 'dncc') OR contains(name, 'north') THEN 'North (DNCC)'
                 WHEN contains(name, 'dscc') OR contains(name, 'south') THEN 'South (DSCC)'
                 ELSE 'Unassigned' END AS label FROM words) AS l
GROUP BY label""")
def b7(t):
    return document_words(t).groupBy(naming.zone_label(F.col("name")).alias("label")).agg(
        F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_rows"))


@query("b8_route_tables", "table n_year_columns route", sql="""
WITH cols AS (
  SELECT 'prices' AS tbl, CAST(year(o_orderdate) AS VARCHAR) AS name FROM orders GROUP BY 2
  UNION ALL SELECT 'annual ' || o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority
  UNION ALL SELECT 'kinds', event_type FROM events GROUP BY event_type)
SELECT tbl AS "table", count(CASE WHEN regexp_full_match(trim(name), '(19|20)\\d{2}') THEN 1 END) AS n_year_columns,
       CASE WHEN regexp_matches(lower(tbl), 'trend|1990|time.?series|annual')
                 OR count(CASE WHEN regexp_full_match(trim(name), '(19|20)\\d{2}') THEN 1 END) >= 3
            THEN 'trend' ELSE 'cross' END AS route
FROM cols GROUP BY tbl""")
def b8(t):
    cols = (t.orders.select(F.lit("prices").alias("table"), F.year("o_orderdate").cast("string").alias("column"))
            .unionByName(t.orders.select(F.concat(F.lit("annual "), "o_orderstatus").alias("table"),
                                         F.col("o_orderpriority").alias("column")))
            .unionByName(t.events.select(F.lit("kinds").alias("table"), F.col("event_type").alias("column"))))
    return R.table_routes(cols.distinct())


# ---- cleaning --------------------------------------------------------------

COERCED = f"""
WITH {OBSERVATIONS},
coerced AS (
  SELECT LST_Celsius AS lst, ndvi_mean AS ndvi, TRY_CAST(surface_albedo AS DOUBLE) AS albedo, elev,
         urban_index AS ui, savi_mean AS savi, humidity, Ward_Name AS ward FROM observations),
known AS (SELECT * FROM coerced WHERE lst IS NOT NULL)"""
CLEANED = f"""{COERCED},
stats AS (
  SELECT count(*) AS n, quantile_cont(lst, 0.5) AS mid, quantile_cont(lst, 0.002) AS lo, quantile_cont(lst, 0.998) AS hi,
         max(abs(ndvi)) AS ndvi_max, quantile_cont(ndvi, 0.5) AS ndvi_mid, quantile_cont(albedo, 0.5) AS albedo_mid,
         count(ndvi) AS ndvi_n, count(albedo) AS albedo_n
  FROM known),
factors AS (
  SELECT *, CASE WHEN mid > 200 THEN 273.15 ELSE 0.0 END AS shift,
         CASE WHEN ndvi_max > 10 THEN power(10.0, ceil(log10(ndvi_max))) ELSE 1.0 END AS f FROM stats),
cleaned AS (
  SELECT least(greatest(lst - shift, lo - shift), hi - shift) AS lst, coalesce(ndvi / f, ndvi_mid / f) AS ndvi,
         coalesce(albedo, albedo_mid) AS albedo, elev, humidity, ward,
         CASE WHEN lst < lo OR lst > hi THEN 1 ELSE 0 END AS is_out
  FROM known, factors)"""


def obs_roles(t) -> R.RoleMap:
    return R.infer_roles(observations(t), "observations")


def cleaned(t) -> C.Cleaned:
    return C.clean(observations(t), obs_roles(t))


def short_names(d: DataFrame) -> DataFrame:
    return d.withColumnsRenamed({"LST_Celsius": "lst", "ndvi_mean": "ndvi", "surface_albedo": "albedo",
                                 "urban_index": "ui", "savi_mean": "savi", "Ward_Name": "ward"})


@query("c1_project_roles", "ward", "lst elev ui savi humidity", f"""{COERCED}
SELECT ward, lst, elev, ui, savi, humidity FROM coerced""")
def c1(t):
    return short_names(C.coerce(observations(t), obs_roles(t)))


@query("c2_coerce_numbers", "ward n n_ndvi n_albedo", "sum_ndvi sum_albedo", f"""{COERCED}
SELECT ward, count(*) AS n, count(ndvi) AS n_ndvi, count(albedo) AS n_albedo, sum(ndvi) AS sum_ndvi,
       sum(albedo) AS sum_albedo FROM coerced GROUP BY ward""")
def c2(t):
    return short_names(C.coerce(observations(t), obs_roles(t))).groupBy("ward").agg(
        F.count(F.lit(1)).alias("n"), F.count("ndvi").alias("n_ndvi"), F.count("albedo").alias("n_albedo"),
        F.sum("ndvi").alias("sum_ndvi"), F.sum("albedo").alias("sum_albedo"))


@query("c3_drop_missing_target", "ward n_before n_after", sql=f"""{COERCED}
SELECT ward, count(*) AS n_before, count(lst) AS n_after FROM coerced GROUP BY ward""")
def c3(t):
    d = short_names(C.coerce(observations(t), obs_roles(t)))
    return d.groupBy("ward").agg(F.count(F.lit(1)).alias("n_before"), F.count("lst").alias("n_after"))


@query("c4_kelvin_to_celsius", "ward", "low high mean", f"""{CLEANED}
SELECT ward, min(lst - shift) AS low, max(lst - shift) AS high, avg(lst - shift) AS mean
FROM known, factors GROUP BY ward""")
def c4(t):
    r = obs_roles(t)
    d = C.coerce(observations(t), r).where(F.col(r.lst).isNotNull())
    mid = C.column_quantiles(d, {r.lst: [0.5]})[r.lst][0]
    shift = C.KELVIN_OFFSET if mid > C.KELVIN_MEDIAN else 0.0
    celsius = F.col("lst") - F.lit(shift)
    return short_names(d).groupBy("ward").agg(F.min(celsius).alias("low"), F.max(celsius).alias("high"),
                                              F.avg(celsius).alias("mean"))


@query("c5_rescale_indices", "ward", "ndvi_low ndvi_high elev_high humidity_high", f"""{CLEANED}
SELECT ward, min(ndvi / f) AS ndvi_low, max(ndvi / f) AS ndvi_high, max(elev) AS elev_high,
       max(humidity) AS humidity_high FROM known, factors GROUP BY ward""")
def c5(t):
    return short_names(cleaned(t).frame).groupBy("ward").agg(
        F.min("ndvi").alias("ndvi_low"), F.max("ndvi").alias("ndvi_high"), F.max("elev").alias("elev_high"),
        F.max("humidity").alias("humidity_high"))


@query("c6_degenerate_predictors", "column", sql=f"""{COERCED},
long AS (
  SELECT 'ndvi_mean' AS c, ndvi AS v FROM known UNION ALL SELECT 'elev', elev FROM known
  UNION ALL SELECT 'urban_index', ui FROM known UNION ALL SELECT 'savi_mean', savi FROM known
  UNION ALL SELECT 'humidity', humidity FROM known)
SELECT c AS "column" FROM long GROUP BY c
HAVING count(v) < greatest(20, 0.05 * count(*)) OR min(v) = max(v)""")
def c6(t):
    return cleaned(t).report.select(F.explode("dropped_degenerate").alias("column"))


@query("c7_winsorise_target", "n n_low n_high", "low high mean", f"""{CLEANED}
SELECT count(*) AS n, count(CASE WHEN lst = lo2 THEN 1 END) AS n_low, count(CASE WHEN lst = hi2 THEN 1 END) AS n_high,
       max(lo2) AS low, max(hi2) AS high, avg(lst) AS mean
FROM (SELECT *, min(lst) OVER () AS lo2, max(lst) OVER () AS hi2 FROM cleaned) AS c""")
def c7(t):
    d = short_names(cleaned(t).frame)
    r = d.agg(F.min("lst").alias("lo"), F.max("lst").alias("hi")).first()
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lst") == r["lo"]).alias("n_low"),
                 F.count_if(F.col("lst") == r["hi"]).alias("n_high"), F.lit(r["lo"]).alias("low"),
                 F.lit(r["hi"]).alias("high"), F.avg("lst").alias("mean"))


@query("c8_impute_medians", "ward n n_ndvi n_albedo", "ndvi_mean albedo_mean", f"""{CLEANED}
SELECT ward, count(*) AS n, count(ndvi) AS n_ndvi, count(albedo) AS n_albedo, avg(ndvi) AS ndvi_mean,
       avg(albedo) AS albedo_mean
FROM cleaned GROUP BY ward""")
def c8(t):
    return short_names(cleaned(t).frame).groupBy("ward").agg(
        F.count(F.lit(1)).alias("n"), F.count("ndvi").alias("n_ndvi"), F.count("albedo").alias("n_albedo"),
        F.avg("ndvi").alias("ndvi_mean"), F.avg("albedo").alias("albedo_mean"))


@query("c9_cleaning_report",
       "rows_dropped_no_target kelvin_to_celsius rescaled dropped target_winsorised cells_imputed final_rows final_features",
       sql=f"""{CLEANED}
SELECT (SELECT count(*) FROM coerced WHERE lst IS NULL) AS rows_dropped_no_target, max(shift) > 0 AS kelvin_to_celsius,
       'NDVI=' || CAST(CAST(max(f) AS BIGINT) AS VARCHAR) AS rescaled, 'savi_mean,urban_index' AS dropped,
       CAST(sum(is_out) AS BIGINT) AS target_winsorised,
       count(*) - count(ndvi) + count(*) - count(albedo) AS cells_imputed, count(*) AS final_rows,
       CAST(4 AS BIGINT) AS final_features
FROM (SELECT *, CASE WHEN lst < lo OR lst > hi THEN 1 ELSE 0 END AS is_out
      FROM known, factors) AS c""")
def c9(t):
    r = cleaned(t).report
    pairs = F.transform(F.map_entries("rescaled"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("bigint").cast("string")))
    return r.select("*", F.array_join(F.array_sort(pairs), ",").alias("rescaled_text"),
                    F.array_join(F.array_sort("dropped_degenerate"), ",").alias("dropped")).drop("rescaled").withColumnRenamed(
        "rescaled_text", "rescaled")


@query("c0_clean_frame", "ward", "lst ndvi albedo elev humidity", f"""{CLEANED}
SELECT ward, lst, ndvi, albedo, elev, humidity FROM cleaned""")
def c0(t):
    return short_names(cleaned(t).frame)


@query("c10_standardise", "o_orderkey", "z_o_totalprice z_flat", """
SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z_o_totalprice,
       0.0 AS z_flat FROM orders""")
def c10(t):
    d = t.orders.select("o_orderkey", "o_totalprice", F.lit(7.0).alias("flat"))
    return C.standardise(d, ["o_totalprice", "flat"])


@query("c11_hash_sample", "o_orderkey", "o_totalprice", f"""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY {hash_sql('o_orderkey', 3)}, o_orderkey LIMIT 4000""")
def c11(t):
    return C.hash_sample(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 4000, 3)


@query("c12_sizeable_zones", "o_custkey n", "total", """
SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12""", dp=2)
def c12(t):
    return C.sizeable_zones(t.orders.select("o_custkey", "o_totalprice"), "o_custkey", 12).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("b9_pool_zones", "_is_north zone_label n", "lst ndvi ndbi", """
WITH zones AS (
  SELECT 'North (DNCC)' AS zone, o_totalprice / 10000.0 AS lst, CAST(o_custkey AS DOUBLE) / 1000000.0 AS ndvi,
         CAST(o_orderkey AS DOUBLE) / 10000000.0 AS ndbi FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT 'South (DSCC)', o_totalprice / 10000.0, CAST(o_custkey AS DOUBLE) / 1000000.0,
         CAST(o_orderkey AS DOUBLE) / 10000000.0 FROM orders WHERE o_orderstatus = 'O'),
bounds AS (SELECT zone, quantile_cont(lst, 0.002) AS lo, quantile_cont(lst, 0.998) AS hi FROM zones GROUP BY zone)
SELECT CAST(CASE WHEN zone = 'North (DNCC)' THEN 1 ELSE 0 END AS INTEGER) AS _is_north, zone AS zone_label,
       count(*) AS n, avg(least(greatest(lst, lo), hi)) AS lst, avg(ndvi) AS ndvi, avg(ndbi) AS ndbi
FROM zones JOIN bounds USING (zone) GROUP BY zone""")
def b9(t):
    def part(status, names):
        return t.orders.where(F.col("o_orderstatus") == status).select(
            (F.col("o_totalprice") / 10000.0).alias(names[0]),
            (F.col("o_custkey").cast("double") / 1000000.0).alias(names[1]),
            (F.col("o_orderkey").cast("double") / 10000000.0).alias(names[2]))

    zones = []
    for status, zone, names in (("F", "North (DNCC)", ("LST_Celsius", "ndvi_mean", "NDBI")),
                                ("O", "South (DSCC)", ("surface_temp", "NDVI", "ndbi_mean"))):
        d = part(status, names)
        zones.append((zone, C.clean(d, R.infer_roles(d, zone))))
    pooled, _ = pool(zones)
    return pooled.groupBy("_is_north", "zone_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("LST").alias("lst"), F.avg("NDVI").alias("ndvi"), F.avg("NDBI").alias("ndbi"))


@query("c13_hash_order", "o_orderkey h", sql=f"""
SELECT o_orderkey, {hash_sql('o_orderkey', 5)} AS h FROM orders""")
def c13(t):
    return t.orders.select("o_orderkey", split_hash("o_orderkey", 5).alias("h"))
