"""Trends, change between zones, climate clusters and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatscape.operators import change, clusters, models, summaries, trend, validate
from heatscape.operators.clean import standardise
from heatscape.operators.spatial import nearest_centre
from heatscape.plans import queries_models as M
from heatscape.plans.bindings import FEATURES, PIXELS, SERIES, pixels, series
from heatscape.plans.registry import query

# ---- trends ----------------------------------------------------------------

WIDE_YEARS = range(1995, 2002)


def wide(t):
    """Mean price per priority with one column per year."""
    return (series(t).groupBy("unit").pivot("year", [str(y) for y in WIDE_YEARS]).agg(F.avg("value"))
            .withColumnRenamed("unit", "ward"))


@query("j1_wide_to_long", "unit year", "value", f"""
WITH {SERIES} SELECT unit, "year", avg("value") AS "value" FROM series GROUP BY unit, "year" """, dp=4)
def j1(t):
    return trend.tidy(wide(t))


@query("j2_long_by_roles", "unit year n", "total", """
SELECT o_orderpriority AS unit, CAST(year(o_orderdate) AS INTEGER) AS "year", count(*) AS n, sum(o_totalprice) AS total
FROM orders GROUP BY 1, 2""", dp=2)
def j2(t):
    d = t.orders.select(F.col("o_orderpriority").alias("ward"), F.year("o_orderdate").alias("year"),
                        F.col("o_totalprice").alias("LST_mean"))
    return trend.tidy(d).groupBy("unit", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("j3_detect_year_column", "unit year n", "total", """
SELECT 'ALL' AS unit, CAST(year(o_orderdate) AS INTEGER) AS "year", count(*) AS n, sum(o_totalprice) AS total
FROM orders GROUP BY 2""", dp=2)
def j3(t):
    d = t.orders.select(F.col("o_orderpriority").alias("flag"), F.col("o_totalprice").alias("reading"),
                        F.year("o_orderdate").alias("season"))
    return trend.tidy(d).groupBy("unit", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


TREND = f"""
{SERIES},
yearly AS (SELECT unit, "year" AS yr, avg("value") AS v FROM series GROUP BY unit, "year"),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY yr) AS i, count(*) OVER (PARTITION BY unit) AS n FROM yearly),
long_enough AS (SELECT * FROM steps WHERE n >= 5),
pairs AS (
  SELECT a.unit, sign(b.v - a.v) AS s, (b.v - a.v) / (b.i - a.i) AS slope
  FROM long_enough a JOIN long_enough b ON a.unit = b.unit AND a.i < b.i),
ties AS (
  SELECT unit, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (
    SELECT unit, v, count(*) AS t FROM long_enough GROUP BY unit, v) AS g GROUP BY unit),
sums AS (SELECT unit, sum(s) AS s, median(slope) AS slope FROM pairs GROUP BY unit),
sizes AS (SELECT unit, max(n) AS n, min(yr) AS y0, max(yr) AS y1, avg(v) AS mean,
                 avg(CASE WHEN i <= greatest(1, n // 3) THEN v END) AS first_mean,
                 avg(CASE WHEN i > n - greatest(1, n // 3) THEN v END) AS last_mean FROM long_enough GROUP BY unit),
z AS (
  SELECT *, CASE WHEN s > 0 THEN (s - 1.0) / sqrt(var) WHEN s < 0 THEN (s + 1.0) / sqrt(var) ELSE 0.0 END AS z FROM (
    SELECT *, (n * (n - 1.0) * (2.0 * n + 5.0) - ties) / 18.0 AS var
    FROM sums JOIN ties USING (unit) JOIN sizes USING (unit)) AS v),
x AS (SELECT *, abs(z) / sqrt(2.0) AS x, 1.0 / (1.0 + 0.5 * abs(z) / sqrt(2.0)) AS t FROM z),
tests AS (
  SELECT *, s / (0.5 * n * (n - 1.0)) AS tau, least(1.0, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196
    + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587
    + t * (-0.82215223 + t * 0.17087277)))))))))) AS p FROM x),
trends AS (
  SELECT *, CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 AND z < 0 THEN 'decreasing'
                 ELSE 'no trend' END AS trend FROM tests)"""


@query("j4_yearly_means", "unit year", "value", f"""
WITH {SERIES} SELECT unit, "year", avg("value") AS "value" FROM series GROUP BY unit, "year" """, dp=4)
def j4(t):
    return trend.yearly_means(series(t))


@query("j5_mann_kendall", "unit trend", "s tau z p", f"WITH {TREND} SELECT unit, trend, s, tau, z, p FROM trends")
def j5(t):
    return trend.mann_kendall(series(t))


@query("j6_sen_slope", "unit", "slope", f"WITH {TREND} SELECT unit, slope FROM trends", dp=4)
def j6(t):
    return trend.pair_statistics(series(t))


@query("j6_sen_slope_daily", "unit", "slope s", """
WITH daily AS (
  SELECT event_type AS unit, CAST(dayofyear(ts) AS INTEGER) AS day, avg("value") AS v FROM events GROUP BY 1, 2),
steps AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY day) AS i FROM daily)
SELECT a.unit, median((b.v - a.v) / (b.i - a.i)) AS slope, sum(sign(b.v - a.v)) AS s
FROM steps a JOIN steps b ON a.unit = b.unit AND a.i < b.i GROUP BY a.unit""")
def j6_daily(t):
    d = t.events.select(F.col("event_type").alias("unit"), F.dayofyear("ts").alias("year"), "value")
    return trend.pair_statistics(d, pairwise_limit=8)


TABLE = "MK_p MK_tau Sen_slope_per_step Sen_slope_per_decade Total_change_C Mean_LST First_period_mean Last_period_mean"
TREND_TABLE = f"""{TREND},
trend_rows AS (
  SELECT 'Unassigned' AS "Zone", unit AS "Unit", y0 || '-' || y1 AS "Years", n AS "N_obs", trend AS "Trend", p AS "MK_p",
         tau AS "MK_tau", slope AS "Sen_slope_per_step",
         slope * 10.0 / ((y1 - y0) / CAST(n - 1 AS DOUBLE)) AS "Sen_slope_per_decade", slope * (n - 1) AS "Total_change_C",
         mean AS "Mean_LST", first_mean AS "First_period_mean", last_mean AS "Last_period_mean" FROM trends)"""


@query("j7_trend_table", "Zone Unit Years N_obs Trend", TABLE, f"WITH {TREND_TABLE} SELECT * FROM trend_rows", dp=4)
def j7(t):
    return trend.trend_table(series(t))


@query("j8_significant_series", "n_series n_significant", sql=f"""
WITH {TREND} SELECT count(*) AS n_series, count(CASE WHEN p < 0.05 THEN 1 END) AS n_significant FROM trends""")
def j8(t):
    return trend.significant_series(trend.trend_table(series(t)))


# ---- change ----------------------------------------------------------------

def zone_rows(t, status):
    return t.orders.where(F.col("o_orderstatus") == status).select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("LST"),
        F.col("o_custkey").cast("double").alias("NDVI"), F.dayofyear("o_orderdate").cast("double").alias("NDBI"))


@query("j9_rank_aligned_change", "rank", "d_LST d_NDVI d_NDBI", """
WITH z AS (
  SELECT o_orderstatus AS zone, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS a, CAST(dayofyear(o_orderdate) AS DOUBLE) AS b,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders)
SELECT f.r AS "rank", o.y - f.y AS "d_LST", o.a - f.a AS "d_NDVI", o.b - f.b AS "d_NDBI"
FROM z f JOIN z o ON f.r = o.r AND f.zone = 'F' AND o.zone = 'O'""", dp=4)
def j9(t):
    return change.rank_aligned(zone_rows(t, "F"), zone_rows(t, "O"), "LST", ["NDVI", "NDBI"], "id")


@query("j9_change_drivers", "Delta_feature Comparison share fits", "total", """
SELECT 'd_' || f AS "Delta_feature", 'O minus F' AS "Comparison", true AS share, true AS fits, 100.0 AS total FROM (VALUES ('NDVI'), ('NDBI')) AS v(f)""")
def j9_drivers(t):
    """Both differences have a share of the importance, the shares add up to 100, and the model explains some of the change."""
    d = change.rank_aligned(zone_rows(t, "F"), zone_rows(t, "O"), "LST", ["NDVI", "NDBI"], "id").persist()
    table = change.change_drivers(d, ["NDBI", "NDVI"], "O minus F", models.boosted("LightGBM", rounds=400))
    whole = table.agg(F.sum("Pct").alias("total"))
    return table.crossJoin(F.broadcast(whole)).select("Delta_feature", "Comparison", F.col("Pct").between(0.0, 100.0).alias("share"),
                                                      F.col("Model_R2_insample").between(0.0, 1.0).alias("fits"), "total")


# ---- clusters --------------------------------------------------------------

@query("k1_silhouette", "", "silhouette", f"""
WITH {PIXELS},
d AS (
  SELECT a.id, a.zone AS own, b.zone AS other, avg(power(a.f2 - b.f2, 2) + power(a.f3 - b.f3, 2)) AS mean_all,
         sum(power(a.f2 - b.f2, 2) + power(a.f3 - b.f3, 2)) / greatest(count(*) - 1, 1) AS mean_own, count(*) AS n
  FROM pixels a CROSS JOIN pixels b GROUP BY a.id, a.zone, b.zone),
s AS (
  SELECT id, max(CASE WHEN own = other THEN mean_own END) AS a, min(CASE WHEN own <> other THEN mean_all END) AS b,
         max(CASE WHEN own = other THEN n END) AS n FROM d GROUP BY id)
SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM s""")
def k1(t):
    return clusters.silhouette(pixels(t), ["f2", "f3"], "zone")


@query("k1_plain_silhouette", "", "silhouette", f"""
WITH {PIXELS},
d AS (
  SELECT a.id, a.zone AS own, b.zone AS other, avg(sqrt(power(a.f2 - b.f2, 2) + power(a.f3 - b.f3, 2))) AS mean_all,
         sum(sqrt(power(a.f2 - b.f2, 2) + power(a.f3 - b.f3, 2))) / greatest(count(*) - 1, 1) AS mean_own, count(*) AS n
  FROM pixels a CROSS JOIN pixels b GROUP BY a.id, a.zone, b.zone),
s AS (
  SELECT id, max(CASE WHEN own = other THEN mean_own END) AS a, min(CASE WHEN own <> other THEN mean_all END) AS b,
         max(CASE WHEN own = other THEN n END) AS n FROM d GROUP BY id)
SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END) AS silhouette FROM s""")
def k1_plain(t):
    value = clusters.plain_silhouettes(pixels(t), ["f2", "f3"], "id", ["zone"])["zone"]
    return t.spark.createDataFrame([(value,)], "silhouette double")


@query("k1_choose_k", "k possible chosen", sql="SELECT CAST(k AS INTEGER) AS k, true AS possible, CAST(1 AS INTEGER) AS chosen FROM range(3, 9) AS r(k)")
def k1_choose(t):
    """Scores for each k are silhouettes, and the greatest of them is that of the one k that is chosen."""
    k, scores = clusters.choose_k(pixels(t), ["f2", "f3", "f4"], key="id")
    best = sum(1 for i, v in scores.items() if v == max(scores.values()) and i == k)
    return t.spark.createDataFrame([(i, -1.0 <= v <= 1.0, best) for i, v in scores.items()], "k int, possible boolean, chosen int")


CLUSTERED = "clusters n nearest"


@query("k2_cluster_rows", CLUSTERED, sql="SELECT CAST(4 AS BIGINT) AS clusters, count(*) AS n, true AS nearest FROM embeddings")
def k2(t):
    """Every row is in one of four clusters, and most rows are nearest to the mean of their own."""
    d = standardise(clusters.cluster_rows(pixels(t), FEATURES, 4), FEATURES)
    zs = [f"z_{c}" for c in FEATURES]
    means = d.groupBy("cluster").agg(*[F.avg(z).alias(z) for z in zs]).orderBy("cluster").collect()
    again = nearest_centre(zs, [[m[z] for z in zs] for m in means])
    return d.agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("n"),
                 (F.avg((again == F.col("cluster")).cast("double")) > 0.9).alias("nearest"))


PROFILE = f"""
{PIXELS},
profile AS (
  SELECT zone, avg(f2) AS f2, avg(f3) AS f3, avg(f4) AS f4, avg(y) AS "Mean_LST_C", count(*) AS "N_pixels",
         100.0 * count(*) / sum(count(*)) OVER () AS "Pct_area" FROM pixels GROUP BY zone)"""


def zone_profile(t):
    return clusters.cluster_profile(pixels(t), ["f2", "f3", "f4"], "y", "zone")


@query("k3_cluster_profile", "zone N_pixels", "f2 f3 f4 Mean_LST_C Pct_area", f"WITH {PROFILE} SELECT * FROM profile")
def k3(t):
    return zone_profile(t)


@query("k4_signatures", "zone Signature", sql=f"""
WITH {PROFILE},
long AS (SELECT zone, 'f2' AS f, f2 AS v FROM profile UNION ALL SELECT zone, 'f3', f3 FROM profile
         UNION ALL SELECT zone, 'f4', f4 FROM profile),
z AS (SELECT zone, f, (v - avg(v) OVER (PARTITION BY f)) / (stddev_samp(v) OVER (PARTITION BY f) + 1e-12) AS z FROM long),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY abs(z) DESC, f) AS nth FROM z)
SELECT zone, string_agg(CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END || f, ' / ' ORDER BY nth) AS "Signature"
FROM r WHERE nth <= 2 GROUP BY zone""")
def k4(t):
    return clusters.signatures(zone_profile(t), ["f2", "f3", "f4"], "zone")


@query("k5_discover_clusters", "n signed in_order", "pct", "SELECT count(*) AS n, true AS signed, true AS in_order, 100.0 AS pct FROM embeddings")
def k5(t):
    """The clusters hold all rows, each has a signature of two features, and the hottest comes first."""
    rows = clusters.discover(pixels(t), ["f2", "f3", "f4"], "y", key="id")[0].collect()
    heat = [r["Mean_LST_C"] for r in rows]
    signed = all(len(r["Signature"].split(" / ")) == 2 for r in rows)
    return t.spark.createDataFrame([(sum(r["N_pixels"] for r in rows), signed, heat == sorted(heat, reverse=True), sum(r["Pct_area"] for r in rows))],
                                   "n bigint, signed boolean, in_order boolean, pct double")


# ---- tables behind figures and report --------------------------------------

@query("l1_dependence_curve", "id feature position", "value shap smooth", f"""
WITH {M.SHAP_SQL},
r AS (SELECT feature, id, v, s, row_number() OVER (PARTITION BY feature ORDER BY v, id) - 1 AS pos,
             count(*) OVER (PARTITION BY feature) AS n FROM long),
w AS (SELECT *, greatest(5, n // 25) AS w FROM r)
SELECT a.id, a.feature, a.pos AS position, any_value(a.v) AS value, any_value(a.s) AS shap, avg(b.s) AS smooth
FROM w a JOIN w b ON a.feature = b.feature AND b.pos BETWEEN a.pos - a.w // 2 AND a.pos + (a.w - 1) // 2
GROUP BY a.id, a.feature, a.pos""")
def l1(t):
    from heatscape.operators import explain

    long = explain.shap_long(M.shap_frame(t)[0], "id", M.PAIR)
    return summaries.rolling_mean(long, "value", "shap", "id", ["feature"])


@query("l1_price_curve", "o_orderkey position", "smooth", """
WITH r AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS v,
                  row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, pos AS position, (sum(v) OVER w) / (count(*) OVER w) AS smooth FROM r
WINDOW w AS (ORDER BY pos ROWS BETWEEN (SELECT greatest(5, count(*) // 25) // 2 FROM orders) PRECEDING
             AND (SELECT (greatest(5, count(*) // 25) - 1) // 2 FROM orders) FOLLOWING)""", dp=4)
def l1_price(t):
    d = t.orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("v"))
    return summaries.rolling_mean(d, "o_totalprice", "v", "o_orderkey")


@query("l2_percentile_rank", "o_orderkey", "percentile", """
SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)
       / CAST(greatest(1, count(*) OVER () - 1) AS DOUBLE) AS percentile FROM orders""")
def l2(t):
    return summaries.percentile_rank(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("l3_histogram", "bin n", sql="""
WITH r AS (SELECT min("value") AS lo, max("value") - min("value") AS w FROM events)
SELECT CAST(least(floor(("value" - lo) / w * 36), 35) AS INTEGER) AS bin, count(*) AS n FROM events, r GROUP BY 1""")
def l3(t):
    return summaries.histogram(t.events, "value")


@query("l3_trust_histogram", "bin n", sql=f"""
WITH {M.TEST_SQL}, r AS (SELECT min(trust_score) AS lo, max(trust_score) - min(trust_score) AS w FROM scored)
SELECT CAST(least(floor((trust_score - lo) / w * 36), 35) AS INTEGER) AS bin, count(*) AS n FROM scored, r GROUP BY 1""")
def l3_trust(t):
    return summaries.histogram(M.scored_test(t)[1], "trust_score")


@query("l4_box_stats", "event_type n", "q1 median q3 low_whisker high_whisker", """
WITH q AS (SELECT event_type, count(*) AS n, quantile_cont("value", 0.25) AS q1, quantile_cont("value", 0.5) AS median,
                  quantile_cont("value", 0.75) AS q3 FROM events GROUP BY event_type)
SELECT event_type, max(n) AS n, max(q1) AS q1, max(median) AS median, max(q3) AS q3, min("value") AS low_whisker,
       max("value") AS high_whisker
FROM events JOIN q USING (event_type)
WHERE "value" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY event_type""")
def l4(t):
    return summaries.box_stats(t.events, "value", ["event_type"])


@query("l5_yearly_line", "unit n_years", "slope intercept", f"""
WITH {SERIES}, y AS (SELECT unit, "year" AS yr, avg("value") AS v FROM series GROUP BY unit, "year")
SELECT unit, count(*) AS n_years, regr_slope(v, yr) AS slope, regr_intercept(v, yr) AS intercept FROM y GROUP BY unit""", dp=2)
def l5(t):
    return summaries.yearly_line(series(t))


@query("l6_steepest_series", "label significant", "Sen_slope_per_decade", f"""
WITH {TREND_TABLE}
SELECT substring(trim(regexp_replace("Zone", '\\(.*?\\)', '', 'g')) || ' · ' || "Unit", 1, 26) AS label,
       "MK_p" < 0.05 AS significant, "Sen_slope_per_decade" FROM trend_rows
ORDER BY "Sen_slope_per_decade" DESC, label LIMIT 14""", dp=4)
def l6(t):
    return summaries.steepest_series(trend.trend_table(series(t)))


@query("l7_top_features", "Zone Feature place", "MeanAbsSHAP", f"""
WITH {M.IMPORTANCE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY "Zone" ORDER BY "MeanAbsSHAP" DESC, "Feature") AS place FROM imp)
SELECT "Zone", "Feature", CAST(place AS INTEGER) AS place, "MeanAbsSHAP" FROM r WHERE place <= 10""")
def l7(t):
    return summaries.top_features(M.zone_importance(t))


@query("l7_dominant_drivers", "Zone warming cooling", sql=f"""
WITH {M.IMPORTANCE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY "Zone", "Direction" ORDER BY "MeanAbsSHAP" DESC, "Feature") AS place FROM imp)
SELECT "Zone", coalesce(string_agg("Feature", ', ' ORDER BY place) FILTER (WHERE "Direction" = 'warming'), '') AS warming,
       coalesce(string_agg("Feature", ', ' ORDER BY place) FILTER (WHERE "Direction" = 'cooling'), '') AS cooling
FROM r WHERE place <= 2 GROUP BY "Zone" """)
def l7_drivers(t):
    return summaries.dominant_drivers(M.zone_importance(t))


@query("l8_report_rollup", "item name", "value", f"""
WITH {M.ZONED_SQL.strip()[5:]}, {TREND},
best AS (SELECT zone, max_by(m, r) AS m, max(r) AS r FROM s GROUP BY zone),
gaps AS (SELECT zone, max(r) - min(r) AS g FROM s GROUP BY zone)
SELECT 'best_model' AS item, zone || ': ' || m AS name, r AS value FROM best
UNION ALL SELECT 'mean_optimism', 'all', avg(g) FROM gaps
UNION ALL SELECT 'significant_series', 'all', CAST(count(CASE WHEN p < 0.05 THEN 1 END) AS DOUBLE) FROM trends
UNION ALL SELECT 'non_stationary_drivers', CAST(zone AS VARCHAR), CAST(count(*) AS DOUBLE) FROM gaps WHERE g > 0.5
GROUP BY zone""")
def l8(t):
    scores = M.zoned_scores(t).persist()
    audit = scores.groupBy("Zone").agg((F.max("R2") - F.min("R2")).alias("optimism"))
    bench = scores.withColumn("Zone", F.col("Zone").cast("string"))
    drivers = audit.select(F.col("Zone").cast("string").alias("Zone"), (F.col("optimism") > 0.5).alias("Non_stationary"))
    return summaries.report_rollup(bench, audit, trend.trend_table(series(t)), drivers)


@query("l9_min_max_heat", "zone", "Mean_LST_C heat", f"""
WITH {PROFILE}
SELECT zone, "Mean_LST_C", ("Mean_LST_C" - min("Mean_LST_C") OVER ()) / (max("Mean_LST_C") OVER () - min("Mean_LST_C") OVER ())
       AS heat FROM profile""")
def l9(t):
    return clusters.min_max(zone_profile(t), "Mean_LST_C", "heat")


@query("f7_top_errors", "zone id place", "abs_error", f"""
WITH {PIXELS}, {M.ols2_sql('pixels')},
e AS (SELECT zone, id, abs(y - b0 - b1 * f2 - b2 * f3) AS abs_error FROM pixels, model),
r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY abs_error DESC, id) AS place FROM e)
SELECT zone, id, CAST(place AS INTEGER) AS place, abs_error FROM r WHERE place <= 5""")
def top_errors(t):
    from heatscape.operators.linear import fit_ols

    d = pixels(t)
    d = fit_ols(d, M.PAIR, "y").transform(d).withColumn("abs_error", F.abs(F.col("y") - F.col("prediction")))
    return validate.top_per_group(d, ["zone"], [F.desc("abs_error"), "id"], 5, "place")
