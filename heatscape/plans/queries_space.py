"""Collinearity, spatial design, neighbours, local regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatscape.functions.columns import hash_bucket
from heatscape.functions.permutation import permuted_sql
from heatscape.functions.ranking import global_rank
from heatscape.operators import collinearity, gwr, linear, neighbours, spatial
from heatscape.operators.clean import standardise
from heatscape.plans.bindings import (FEATURES, PIXELS, READINGS, bucket_sql, distance2_sql, hash_sql, ols2_sql,
                                      pixels, readings)
from heatscape.plans.registry import query

# ---- collinearity ----------------------------------------------------------

PRICES = """
prices AS (
  SELECT l_extendedprice AS price, l_extendedprice * (1.0 - l_discount) AS net, l_tax * l_extendedprice AS taxed
  FROM lineitem)"""
VIF_SQL = f"""
WITH {PRICES},
r AS (SELECT corr(price, net) AS a, corr(price, taxed) AS b, corr(net, taxed) AS c FROM prices),
d AS (SELECT *, 1.0 - a * a - b * b - c * c + 2.0 * a * b * c AS det FROM r),
vif AS (
  SELECT 'price' AS feature, (1.0 - c * c) / det AS vif, 1 AS i FROM d
  UNION ALL SELECT 'net', (1.0 - b * b) / det, 2 FROM d
  UNION ALL SELECT 'taxed', (1.0 - a * a) / det, 3 FROM d)"""


def prices(t):
    p, disc = F.col("l_extendedprice"), F.col("l_discount")
    return t.lineitem.select(p.alias("price"), (p * (F.lit(1.0) - disc)).alias("net"), (F.col("l_tax") * p).alias("taxed"))


@query("d1_variance_inflation", "feature", "vif", f"{VIF_SQL} SELECT feature, vif FROM vif", dp=4)
def d1(t):
    return collinearity.vif_table(prices(t), ["price", "net", "taxed"])


@query("d2_backward_screen", "feature action", "vif", f"""{VIF_SQL},
worst AS (SELECT max(vif) AS top FROM vif)
SELECT feature, CASE WHEN top > 10 THEN 'removed' ELSE 'retained' END AS action, vif
FROM vif, worst WHERE top <= 10 OR vif = top""", dp=4)
def d2(t):
    return collinearity.vif_screen(prices(t), ["price", "net", "taxed"])[1]


@query("d3_correlation_matrix", "a b", "r", f"""
WITH {PIXELS}
SELECT 'f2' AS a, 'f3' AS b, corr(f2, f3) AS r FROM pixels UNION ALL SELECT 'f2', 'f4', corr(f2, f4) FROM pixels
UNION ALL SELECT 'f3', 'f4', corr(f3, f4) FROM pixels""")
def d3(t):
    cols = ["f2", "f3", "f4"]
    r = collinearity.correlation_matrix(pixels(t), cols)
    rows = [(cols[i], cols[j], float(r[i, j])) for i in range(3) for j in range(i + 1, 3)]
    return t.spark.createDataFrame(rows, "a string, b string, r double")


# ---- blocks and folds ------------------------------------------------------

CENTRES = """
centres AS (SELECT zone AS block, avg(lon) AS lon, avg(lat) AS lat FROM pixels GROUP BY zone)"""
BLOCKED = f"""{PIXELS}, {CENTRES},
blocked AS (
  SELECT id, block FROM (
    SELECT p.id, c.block, row_number() OVER (PARTITION BY p.id ORDER BY {distance2_sql('p', 'c', ['lon', 'lat'])}, c.block) AS nth
    FROM pixels p CROSS JOIN centres c) AS n WHERE nth = 1)"""


def label_blocks(t):
    """Pixels with the number of the nearest of the mean positions of the zones."""
    d = pixels(t)
    centres = d.groupBy("zone").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")).orderBy("zone").collect()
    return d.withColumn("block", spatial.nearest_centre(["lon", "lat"], [(c["lon"], c["lat"]) for c in centres]))


@query("e1_nearest_centre_blocks", "id block", sql=f"WITH {BLOCKED} SELECT id, block FROM blocked")
def e1(t):
    return label_blocks(t)


BLOCKS_SQL = "SELECT CAST(10 AS BIGINT) AS blocks, count(*) AS n, true AS sizeable FROM embeddings"


def _block_sizes(d):
    sizes = d.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("n"), (F.min("size") > 0).alias("sizeable"))


@query("e1_spatial_blocks", "blocks n sizeable", sql=BLOCKS_SQL)
def e1_kmeans(t):
    """Ten blocks that hold all rows."""
    return _block_sizes(spatial.spatial_blocks(pixels(t), "lon", "lat", FEATURES, "id")[0])


@query("e2_feature_blocks", "blocks n sizeable", sql=BLOCKS_SQL)
def e2(t):
    return _block_sizes(spatial.spatial_blocks(pixels(t), None, None, FEATURES, "id")[0])


@query("e3_row_blocks", "o_orderkey block", sql="SELECT o_orderkey, CAST(o_orderkey % 10 AS INTEGER) AS block FROM orders")
def e3(t):
    return spatial.spatial_blocks(t.orders, None, None, [], "o_orderkey")[0]


GROUP_FOLDS = f"""{BLOCKED},
sizes AS (SELECT block, n, row_number() OVER (ORDER BY n DESC, block DESC) AS i FROM (
  SELECT block, count(*) AS n FROM blocked GROUP BY block) AS s),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS block, CAST(NULL AS BIGINT) AS fold, CAST(NULL AS BIGINT) AS n,
         CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS e
  UNION ALL
  SELECT i, block, fold, n, a + CASE WHEN fold = 0 THEN n ELSE 0 END, b + CASE WHEN fold = 1 THEN n ELSE 0 END,
         c + CASE WHEN fold = 2 THEN n ELSE 0 END, d + CASE WHEN fold = 3 THEN n ELSE 0 END,
         e + CASE WHEN fold = 4 THEN n ELSE 0 END
  FROM (SELECT s.i, s.block, s.n, w.a, w.b, w.c, w.d, w.e,
               CAST(CASE least(w.a, w.b, w.c, w.d, w.e) WHEN w.a THEN 0 WHEN w.b THEN 1 WHEN w.c THEN 2 WHEN w.d THEN 3
                    ELSE 4 END AS BIGINT) AS fold
        FROM walk w JOIN sizes s ON s.i = w.i + 1) AS step)"""


@query("e4_group_folds", "block fold n", sql=f"""
WITH RECURSIVE {GROUP_FOLDS} SELECT block, CAST(fold AS INTEGER) AS fold, n FROM walk WHERE i > 0""")
def e4(t):
    d = spatial.assign_folds(label_blocks(t), "id")
    return d.groupBy("block", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("e5_random_folds", "o_orderkey fold", sql=f"SELECT o_orderkey, {bucket_sql('o_orderkey', 5)} AS fold FROM orders")
def e5(t):
    return spatial.random_folds(t.orders, "o_orderkey")


# ---- autocorrelation and neighbours ----------------------------------------

def moran_sql(source: str, value: str) -> str:
    return f"""
z AS (SELECT id, lon, lat, {value} - avg({value}) OVER () AS z FROM {source}),
near AS (
  SELECT a.id, a.z AS zi, b.z AS zj,
         row_number() OVER (PARTITION BY a.id ORDER BY {distance2_sql('a', 'b', ['lon', 'lat'])}, b.id) AS nth
  FROM z a JOIN z b ON a.id <> b.id)
SELECT CAST((SELECT count(*) FROM z) AS BIGINT) AS n, CAST(8 AS INTEGER) AS k,
       sum(zi * zj) / 8.0 / (SELECT sum(z * z) FROM z) AS morans_i
FROM near WHERE nth <= 8"""


@query("e6_morans_i", "n k", "morans_i", f"WITH {PIXELS}, {moran_sql('pixels', 'y')}")
def e6(t):
    return spatial.morans_i(pixels(t), "y", "lon", "lat", "id")


@query("e6_morans_i_readings", "n k", "morans_i", f"""
WITH {READINGS},
z AS (SELECT id, lon, lat, v - avg(v) OVER () AS z FROM readings),
found AS (
  SELECT a.id, max(a.z) AS zi, min({{'d': {distance2_sql('a', 'b', ['lon', 'lat'])}, 'r': b.id, 'z': b.z}}, 8) AS near
  FROM z a JOIN z b ON a.id <> b.id GROUP BY a.id),
edges AS (SELECT zi, unnest(near) AS o FROM found)
SELECT CAST((SELECT count(*) FROM z) AS BIGINT) AS n, CAST(8 AS INTEGER) AS k,
       sum(zi * o.z) / 8.0 / (SELECT sum(z * z) FROM z) AS morans_i FROM edges""")
def e6_readings(t):
    return spatial.morans_i(readings(t), "v", "lon", "lat", "id")


KNN_SQL = """
SELECT query_id, ref_id, distance, CAST(nth AS INTEGER) AS "rank" FROM (
  SELECT a.id AS query_id, b.id AS ref_id, sqrt({d}) AS distance,
         row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS nth
  FROM {src} a JOIN {src} b ON a.id <> b.id) AS n WHERE nth <= {k}"""


@query("e8_knn_plane", "query_id ref_id rank", "distance", f"""
WITH {PIXELS} {KNN_SQL.format(d=distance2_sql('a', 'b', ['lon', 'lat']), src='pixels', k=8)}""")
def e8(t):
    d = pixels(t)
    return neighbours.knn(d, d, ["lon", "lat"], 8, "id", exclude_self=True)


@query("e8_knn_features", "query_id ref_id rank", "distance", f"""
WITH {PIXELS} {KNN_SQL.format(d=distance2_sql('a', 'b', FEATURES), src='pixels', k=10)}""")
def e8_features(t):
    d = pixels(t)
    return neighbours.knn(d, d, FEATURES, 10, "id", exclude_self=True)


@query("e8_knn_readings", "query_id ref_id rank", "distance", f"""
WITH {READINGS},
found AS (
  SELECT a.id AS query_id,
         list_sort(min({{'d': {distance2_sql('a', 'b', ['lon', 'lat'])}, 'r': b.id}}, 8)) AS near
  FROM readings a JOIN readings b ON a.id <> b.id GROUP BY a.id),
rows AS (SELECT query_id, unnest(near) AS o, generate_subscripts(near, 1) AS nth FROM found)
SELECT query_id, o.r AS ref_id, sqrt(o.d) AS distance, CAST(nth AS INTEGER) AS "rank" FROM rows""")
def e8_readings(t):
    d = readings(t)
    return neighbours.knn(d, d, ["lon", "lat"], 8, "id", exclude_self=True)


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
LINE_DIMS = {"d0": "l_quantity / 50e0", "d1": "l_extendedprice / 1e5", "d2": "l_discount * 10e0", "d3": "l_tax * 125e-1", "d4": "l_suppkey / 100e0",
             "d5": "l_linenumber / 7e0"}


# all rows against all rows, in six dimensions
@query("e8_knn_lineitem", "query_id ref_id rank", "distance", f"""
WITH numbered AS (SELECT row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) - 1 AS id, * FROM lineitem),
points AS (SELECT id, {', '.join(f"CAST({e} AS DOUBLE) AS {d}" for d, e in LINE_DIMS.items())} FROM numbered),
found AS (
  SELECT a.id AS query_id, list_sort(min({{'d': {distance2_sql('a', 'b', list(LINE_DIMS))}, 'r': b.id}}, 8)) AS near
  FROM points a JOIN points b ON a.id <> b.id GROUP BY a.id),
rows AS (SELECT query_id, unnest(near) AS o, generate_subscripts(near, 1) AS nth FROM found)
SELECT query_id, o.r AS ref_id, sqrt(o.d) AS distance, CAST(nth AS INTEGER) AS "rank" FROM rows""")
def e8_lineitem(t):
    numbered = global_rank(t.lineitem.select(*LINE_COLUMNS), LINE_COLUMNS, out="id")
    points = numbered.selectExpr("id", *[f"cast({e} as double) as {d}" for d, e in LINE_DIMS.items()])
    return neighbours.knn(points, points, list(LINE_DIMS), 8, "id", exclude_self=True)


# ---- geographically weighted regression ------------------------------------

BANDWIDTH = 60
JITTERED = f"""{PIXELS},
jittered AS (
  SELECT id, y, (f2 - avg(f2) OVER ()) / stddev_pop(f2) OVER () AS x,
         lon + (CAST({hash_sql('id', 1)} AS DOUBLE) / 2147483648.0 - 0.5) * 1e-7 AS lon,
         lat + (CAST({hash_sql('id', 2)} AS DOUBLE) / 2147483648.0 - 0.5) * 1e-7 AS lat
  FROM pixels)"""
# one predictor: the local fit has a closed form; the same small ridge term is added
LOCAL = f"""{JITTERED},
pairs AS (
  SELECT a.id, a.x AS fx, a.y AS fy, b.x, b.y, sqrt({distance2_sql('a', 'b', ['lon', 'lat'])}) AS d
  FROM jittered a CROSS JOIN jittered b),
edges AS (
  SELECT id, d AS h FROM (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS nth FROM pairs) AS n
  WHERE nth = {BANDWIDTH}),
sums AS (
  SELECT id, max(fx) AS fx, max(fy) AS fy, sum(w) AS w0, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy,
         sum(w * x * y) AS wxy
  FROM (SELECT p.*, CASE WHEN d < h THEN power(1.0 - (d / h) * (d / h), 2) ELSE 0.0 END AS w
        FROM pairs p JOIN edges USING (id)) AS k GROUP BY id),
fits AS (
  SELECT id, fx, fy, (g11 * wy - wx * wxy) / det AS a, (g00 * wxy - wx * wy) / det AS b,
         (g11 - 2.0 * wx * fx + g00 * fx * fx) / det AS leverage
  FROM (SELECT *, g00 * g11 - wx * wx AS det FROM (
    SELECT *, w0 + 1e-8 * (w0 + wxx) / 2.0 AS g00, wxx + 1e-8 * (w0 + wxx) / 2.0 AS g11 FROM sums) AS s) AS t)"""


def _local(t, bandwidth: int = BANDWIDTH):
    focal, sample = gwr.take_points(pixels(t), "id", "lon", "lat", ["f2"], "y")
    return focal, sample, gwr.local_coefficients(focal, sample, ["f2"], bandwidth)


@query("g1_local_regression", "focal_id", "intercept slope fitted leverage", f"""
WITH {LOCAL}
SELECT id AS focal_id, a AS intercept, b AS slope, a + b * fx AS fitted, leverage FROM fits""", dp=5)
def g1(t):
    return _local(t)[2].select("focal_id", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope"),
                               "fitted", "leverage")


# one predictor: sums over the rows nearer than each row give the fits at every bandwidth at once
EVERY_FIT = f"""{JITTERED},
pairs AS (
  SELECT a.id, a.x AS fx, a.y AS fy, b.x, b.y, {distance2_sql('a', 'b', ['lon', 'lat'])} AS q FROM jittered a CROSS JOIN jittered b),
nearer AS (
  SELECT id, fx, fy, q AS hh, row_number() OVER w AS bw,
         {', '.join(f"sum({v} * power(q, {p})) OVER w - {v} * power(q, {p}) AS s{k}{p}"
                    for k, v in enumerate(['1.0', 'x', 'x * x', 'y', 'x * y']) for p in range(3))}
  FROM pairs WINDOW w AS (PARTITION BY id ORDER BY q ROWS UNBOUNDED PRECEDING)),
weighted AS (
  SELECT id, fx, fy, bw, {', '.join(f"s{k}0 - 2.0 * s{k}1 / hh + s{k}2 / (hh * hh) AS w{k}" for k in range(5))} FROM nearer WHERE bw >= 40),
every_fit AS (
  SELECT bw, fx, fy, (g11 * w3 - w1 * w4) / det AS a, (g00 * w4 - w1 * w3) / det AS b, (g11 - 2.0 * w1 * fx + g00 * fx * fx) / det AS leverage
  FROM (SELECT *, g00 * g11 - w1 * w1 AS det FROM (
    SELECT *, w0 + 1e-8 * (w0 + w2) / 2.0 AS g00, w2 + 1e-8 * (w0 + w2) / 2.0 AS g11 FROM weighted) AS s) AS t),
aiccs AS MATERIALIZED (
  SELECT bw, n, k, rss, n * ln(rss / n) + n * (1.0 + ln(2.0 * pi())) + 2.0 * n * (k + 1.0) / greatest(n - k - 2.0, 1.0) AS aicc
  FROM (SELECT bw, count(*) AS n, sum(power(fy - a - b * fx, 2)) AS rss, sum(leverage) AS k FROM every_fit GROUP BY bw) AS f)"""
# the same golden section, step by step
GOLDEN_SEARCH = f"""{EVERY_FIT},
ends AS (SELECT least(max(n), 44) * 1.0::DOUBLE AS lo, max(n) * 1.0::DOUBLE AS hi FROM aiccs),
search AS (
  SELECT lo AS a, lo + {gwr.GOLDEN}::DOUBLE * (hi - lo) AS b, hi AS c, hi - {gwr.GOLDEN}::DOUBLE * (hi - lo) AS d FROM ends
  UNION ALL
  SELECT CASE WHEN lower THEN a ELSE b END, CASE WHEN lower THEN a + {gwr.GOLDEN}::DOUBLE * (d - a) ELSE d END,
         CASE WHEN lower THEN d ELSE c END, CASE WHEN lower THEN b ELSE c - {gwr.GOLDEN}::DOUBLE * (c - b) END
  FROM (SELECT s.*, p.aicc <= q.aicc AS lower FROM search s JOIN aiccs p ON p.bw = round_even(s.b, 0) JOIN aiccs q ON q.bw = round_even(s.d, 0)
        WHERE round_even(s.b, 0) <> round_even(s.d, 0)) AS t),
probed AS (SELECT round_even(b, 0) AS bw FROM search UNION SELECT round_even(d, 0) FROM search UNION SELECT lo FROM ends UNION SELECT hi FROM ends),
best AS (SELECT * FROM aiccs WHERE bw IN (SELECT bw FROM probed) ORDER BY aicc, bw LIMIT 1)"""


@query("g2_bandwidth_search", "bandwidth n", sql=f"""
WITH RECURSIVE {GOLDEN_SEARCH} SELECT CAST(bw AS INTEGER) AS bandwidth, n FROM best""")
def g2(t):
    focal, sample = gwr.take_points(pixels(t), "id", "lon", "lat", ["f2"], "y")
    bw = gwr.select_bandwidth(focal, sample, ["f2"])
    return focal.agg(F.count(F.lit(1)).alias("n")).withColumn("bandwidth", F.lit(bw))


@query("g2_bandwidth_scores", "bandwidth", "k aicc", f"""
WITH {EVERY_FIT}
SELECT CAST(bw AS INTEGER) AS bandwidth, k, aicc FROM aiccs WHERE bw IN (n // 8, n // 4, n // 2, n - 1, n)""", dp=4)
def g2_scores(t):
    focal, sample = gwr.take_points(pixels(t), "id", "lon", "lat", ["f2"], "y")
    n = sample.n
    return gwr.bandwidth_scores(focal, sample, ["f2"], [n // 8, n // 4, n // 2, n - 1, n])


@query("g3_global_ols", "n", "intercept slope se r2 aicc", f"""
WITH {JITTERED},
m AS (SELECT count(*) AS n, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy,
             regr_sxx(y, x) AS sxx FROM jittered),
e AS (SELECT *, (1.0 - r2) * syy AS rss FROM m)
SELECT n, a AS intercept, b AS slope, sqrt(rss / (n - 2) / sxx) AS se, r2,
       n * ln(rss / n) + n * (1.0 + ln(2.0 * pi())) + 2.0 * n * 3.0 / (n - 4.0) AS aicc FROM e""", dp=5)
def g3(t):
    d = standardise(pixels(t), ["f2"])
    m = linear.fit_ols(d, ["z_f2"], "y")
    syy = d.agg(F.var_pop("y") * F.count("y")).first()[0]
    return t.spark.createDataFrame(
        [(m.n, m.intercept, float(m.coef[0]), float(m.se[0]), 1.0 - m.rss / syy, float(gwr.aicc(m.rss, m.n, 2)))],
        "n bigint, intercept double, slope double, se double, r2 double, aicc double")


@query("g4_aicc_gate", "justified", "aicc_local aicc_global delta", f"""
WITH {LOCAL},
loc AS (SELECT count(*) AS n, sum(power(fy - a - b * fx, 2)) AS rss, sum(leverage) AS k FROM fits),
overall AS (SELECT (1.0 - regr_r2(y, x)) * regr_syy(y, x) AS rss FROM jittered),
scores AS (
  SELECT n * ln(loc.rss / n) + n * (1.0 + ln(2.0 * pi())) + 2.0 * n * (k + 1.0) / (n - k - 2.0) AS aicc_local,
         n * ln(overall.rss / n) + n * (1.0 + ln(2.0 * pi())) + 2.0 * n * 3.0 / (n - 4.0) AS aicc_global
  FROM loc, overall)
SELECT aicc_local, aicc_global, aicc_global - aicc_local AS delta, aicc_global - aicc_local > 3.0 AS justified
FROM scores""", dp=3)
def g4(t):
    out = gwr.gwr(pixels(t), "id", "lon", "lat", ["f2"], "y", n_perm=0, bandwidth=BANDWIDTH)
    return out["meta"].select(F.col("aicc").alias("aicc_local"), F.col("aicc_ols").alias("aicc_global"),
                              F.col("delta_aicc").alias("delta"), F.col("gwr_justified").alias("justified"))


@query("g5_permutation_spread", "perm feature", "iqr", f"""
WITH {JITTERED},
placed AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM jittered),
{permuted_sql('placed', 'place', 42, gwr.PERMUTATIONS)},
arrived AS (SELECT m.perm, b.id, a.x, a.y FROM moved m JOIN placed a ON a.place = m.place JOIN placed b ON b.place = m.x),
pairs AS (SELECT a.id, b.id AS other, sqrt({distance2_sql('a', 'b', ['lon', 'lat'])}) AS d FROM jittered a CROSS JOIN jittered b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS nth FROM pairs),
near AS (SELECT r.id, r.other, power(1.0 - (r.d / e.d) * (r.d / e.d), 2) AS w
         FROM ranked r JOIN ranked e ON e.id = r.id AND e.nth = {BANDWIDTH} WHERE r.nth < {BANDWIDTH}),
sums AS (SELECT perm, n.id, sum(w) AS w0, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(w * y) AS wy, sum(w * x * y) AS wxy
         FROM near n JOIN arrived v ON v.id = n.other GROUP BY perm, n.id),
slopes AS (SELECT perm, (g00 * wxy - wx * wy) / (g00 * g11 - wx * wx) AS b FROM (
  SELECT *, w0 + 1e-8 * (w0 + wxx) / 2.0 AS g00, wxx + 1e-8 * (w0 + wxx) / 2.0 AS g11 FROM sums) AS s)
SELECT CAST(perm AS INTEGER) AS perm, 'f2' AS feature, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS iqr FROM slopes GROUP BY perm""", dp=5)
def g5(t):
    focal, sample = gwr.take_points(pixels(t), "id", "lon", "lat", ["f2"], "y")
    return gwr.permuted_spreads(focal, sample, ["f2"], BANDWIDTH)


@query("g6_driver_summary", "Feature",
       "Global_coef Global_SE Local_mean Local_min Local_max Local_IQR Sign_flips_pct", f"""
WITH {LOCAL},
m AS (SELECT count(*) AS n, regr_slope(y, x) AS g, (1.0 - regr_r2(y, x)) * regr_syy(y, x) AS rss, regr_sxx(y, x) AS sxx
      FROM jittered)
SELECT 'f2' AS "Feature", max(g) AS "Global_coef", max(sqrt(rss / (n - 2) / sxx)) AS "Global_SE", avg(b) AS "Local_mean",
       min(b) AS "Local_min", max(b) AS "Local_max", quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS "Local_IQR",
       100.0 * avg(CASE WHEN sign(b) <> sign(g) THEN 1.0 ELSE 0.0 END) AS "Sign_flips_pct"
FROM fits, m""", dp=5)
def g6(t):
    focal, _, local = _local(t)
    ols = linear.fit_ols(focal, ["z_f2"], "y")
    ols.features = ["f2"]
    return gwr.coefficient_summary(local, ols)


@query("g7_gwr_run", "bandwidth n_points gwr_justified n_perm", "gwr_R2 ols_R2 aicc aicc_ols delta_aicc", f"""
WITH RECURSIVE {GOLDEN_SEARCH},
overall AS (SELECT (1.0 - regr_r2(y, x)) * regr_syy(y, x) AS orss, regr_syy(y, x) AS tss, regr_r2(y, x) AS r2 FROM jittered),
scores AS (SELECT *, n * ln(orss / n) + n * (1.0 + ln(2.0 * pi())) + 2.0 * n * 3.0 / (n - 4.0) AS aicc_ols FROM best, overall)
SELECT CAST(bw AS INTEGER) AS bandwidth, n AS n_points, aicc_ols - aicc > 3.0 AS gwr_justified, CAST({gwr.PERMUTATIONS} AS INTEGER) AS n_perm,
       1.0 - rss / tss AS "gwr_R2", r2 AS "ols_R2", aicc, aicc_ols, aicc_ols - aicc AS delta_aicc FROM scores""", dp=4)
def g7(t):
    return gwr.gwr(pixels(t), "id", "lon", "lat", ["f2"], "y")["meta"]


@query("g7_gwr_run_features", "n_points possible", "gain", "SELECT count(*) AS n_points, true AS possible, 0.0 AS gain FROM embeddings")
def g7_features(t):
    """With several predictors: the bandwidth is one of the search's, and the gain is the difference of both scores."""
    m = gwr.gwr(pixels(t), "id", "lon", "lat", ["f2", "f3", "f4"], "y")["meta"]
    return m.select("n_points", (F.col("bandwidth").between(48, F.col("n_points")) & (F.col("gwr_R2") >= F.col("ols_R2"))).alias("possible"),
                    (F.col("delta_aicc") - F.col("aicc_ols") + F.col("aicc")).alias("gain"))


@query("e5_fold_sizes", "fold n", sql=f"""
SELECT fold, count(*) AS n FROM (SELECT {bucket_sql('event_id', 5, 1)} AS fold FROM events) AS f GROUP BY fold""")
def e5_sizes(t):
    return t.events.groupBy(hash_bucket("event_id", 5, 1).alias("fold")).agg(F.count(F.lit(1)).alias("n"))
