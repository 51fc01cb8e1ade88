"""Regression, validation, attribution and the confidence gate."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import functions as F

from heatscape.functions.columns import r2
from heatscape.functions.permutation import permuted_sql
from heatscape.operators import boosting, explain, gatekeeper, linear, models, random_trees, spatial, trees, validate
from heatscape.plans.bindings import (FEATURES, PARTED, PIXELS, bucket_sql, distance2_sql, hash_sql, ols2_sql, parted,
                                      pixels)
from heatscape.plans.queries_space import GROUP_FOLDS, label_blocks, moran_sql
from heatscape.plans.registry import query
from heatscape.session import side_by_side

PAIR = ["f2", "f3"]
FOLDED = f"""{GROUP_FOLDS},
folded AS (
  SELECT p.*, CAST(w.fold AS INTEGER) AS fold, {bucket_sql('p.id', 5, 9)} AS random_fold
  FROM pixels p JOIN blocked b ON b.id = p.id JOIN walk w ON w.block = b.block AND w.i > 0)"""


def folded(t):
    """Pixels with spatial folds, whole blocks of nearest centres, and random ones."""
    d = spatial.assign_folds(label_blocks(t), "id")
    return spatial.random_folds(d, "id", 5, 9, "random_fold")


def oof_sql(fold: str = "fold", name: str = "oof") -> str:
    """CTE of predictions by two-feature least squares trained on the other folds."""
    return f"""
{name}_rows AS (
  SELECT f.held AS held, p.f2, p.f3, p.y FROM (SELECT DISTINCT {fold} AS held FROM folded) f
  JOIN folded p ON p.{fold} <> f.held),
{ols2_sql(name + '_rows', name + '_model', group='held')},
{name} AS (
  SELECT p.id, p.{fold} AS fold, p.y, m.b0 + m.b1 * p.f2 + m.b2 * p.f3 AS prediction
  FROM folded p JOIN {name}_model m ON m.held = p.{fold})"""


R2_SQL = "1.0 - sum(power(y - prediction, 2)) / (var_pop(y) * count(*))"


@query("f1_ols", "n", "b0 b1 b2 rss", f"""
WITH {PIXELS}, {ols2_sql('pixels')}
SELECT n, b0, b1, b2, n * (syy - b1 * s1y - b2 * s2y) AS rss FROM model""")
def f1(t):
    m = linear.fit_ols(pixels(t), PAIR, "y")
    return t.spark.createDataFrame([(m.n, m.intercept, float(m.coef[0]), float(m.coef[1]), m.rss)],
                                   "n bigint, b0 double, b1 double, b2 double, rss double")


@query("f1_ols_lineitem", "n", "b0 b1 b2", f"""
WITH rows AS (SELECT l_extendedprice AS y, l_quantity AS f2, l_discount AS f3 FROM lineitem), {ols2_sql('rows')}
SELECT n, b0, b1, b2 FROM model""", dp=3)
def f1_lineitem(t):
    d = t.lineitem.select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("f2"), F.col("l_discount").alias("f3"))
    m = linear.fit_ols(d, PAIR, "y")
    return t.spark.createDataFrame([(m.n, m.intercept, float(m.coef[0]), float(m.coef[1]))],
                                   "n bigint, b0 double, b1 double, b2 double")


@query("f2_ridge_loo", "step", "alpha loo_mse", f"""
WITH {PIXELS}, {ols2_sql('pixels')},
alphas AS (SELECT i AS step, power(10.0, -3.0 + i * 0.25) AS alpha FROM range(25) AS r(i)),
solved AS (
  SELECT *, a22 / det AS i11, -a12 / det AS i12, a11 / det AS i22 FROM (
    SELECT *, a11 * a22 - a12 * a12 AS det FROM (
      SELECT alphas.*, n, m1, m2, my, sqrt(s11) AS d1, sqrt(s22) AS d2, n + alpha AS a11, n + alpha AS a22,
             n * s12 / sqrt(s11 * s22) AS a12, n * s1y / sqrt(s11) AS g1, n * s2y / sqrt(s22) AS g2
      FROM alphas, model) AS a) AS b)
SELECT CAST(step AS INTEGER) AS step, alpha, avg(power((yc - z1 * (i11 * g1 + i12 * g2) - z2 * (i12 * g1 + i22 * g2))
       / (1.0 - 1.0 / n - i11 * z1 * z1 - 2.0 * i12 * z1 * z2 - i22 * z2 * z2), 2)) AS loo_mse
FROM (SELECT s.*, (p.f2 - m1) / d1 AS z1, (p.f3 - m2) / d2 AS z2, p.y - my AS yc FROM solved s, pixels p) AS r
GROUP BY step, alpha""")
def f2(t):
    d = pixels(t)
    m = linear.moments(d, [*PAIR, "y"])
    errors = linear.loo_errors(d, PAIR, "y", m)
    rows = [(i, a, float(e)) for i, (a, e) in enumerate(zip(linear.RIDGE_ALPHAS, errors))]
    return t.spark.createDataFrame(rows, "step int, alpha double, loo_mse double")


def _quality(t, fit):
    d = folded(t).select("id", *FEATURES, "y").persist()
    return validate.error_metrics(fit(d, FEATURES, "y").transform(d))


METRICS = "R2 RMSE MAE Bias MaxAbsErr"


# closed form of two standardised features: least squares with alpha added to both diagonal entries; alpha by leave-one-out error
RIDGE_SQL = f"""{PIXELS}, {ols2_sql('pixels')},
scaled AS (SELECT p.id, p.y, p.y - my AS c, (f2 - m1) / sqrt(s11) AS z1, (f3 - m2) / sqrt(s22) AS z2, n * 1.0 AS n FROM pixels p, model),
g AS (SELECT max(n) AS n, sum(z1 * z2) AS r, sum(z1 * c) AS u, sum(z2 * c) AS v FROM scaled),
alphas AS (SELECT power(10.0::DOUBLE, -3.0 + 6.0 * i / 24.0) AS alpha FROM range(25) AS t(i)),
solved AS (
  SELECT alpha, n, (n + alpha) AS d, r, (n + alpha) * (n + alpha) - r * r AS det, ((n + alpha) * u - r * v) / ((n + alpha) * (n + alpha) - r * r) AS b1,
         ((n + alpha) * v - r * u) / ((n + alpha) * (n + alpha) - r * r) AS b2 FROM g, alphas),
errors AS (
  SELECT alpha, avg(power((c - b1 * z1 - b2 * z2) / (1.0 - 1.0 / s.n - (d * z1 * z1 - 2.0 * r * z1 * z2 + d * z2 * z2) / det), 2)) AS loo
  FROM scaled s, solved GROUP BY alpha),
chosen AS (SELECT * FROM solved WHERE alpha = (SELECT alpha FROM errors ORDER BY loo, alpha LIMIT 1)),
p AS (SELECT s.y, m.my + c.b1 * z1 + c.b2 * z2 AS prediction FROM scaled s, chosen c, model m)"""
METRICS_SQL = f"""SELECT {R2_SQL} AS "R2", sqrt(avg(power(y - prediction, 2))) AS "RMSE", avg(abs(y - prediction)) AS "MAE",
       avg(y - prediction) AS "Bias", max(abs(y - prediction)) AS "MaxAbsErr" FROM"""


@query("f2_ridge_fit", "", METRICS, f"WITH {RIDGE_SQL} {METRICS_SQL} p")
def f2_fit(t):
    d = pixels(t)
    return validate.error_metrics(linear.fit_ridge(d, PAIR, "y").transform(d))


def sound(t, fit, name: str):
    """What must hold for any good model: a finite prediction for every row, nearer to the target than its mean is, and within its range."""
    d = pixels(t).select("id", *FEATURES, "y")
    p = fit(d, FEATURES, "y").transform(d)
    m = p.agg(F.count("prediction").alias("n"), r2("y", "prediction").alias("r"), F.min("prediction").alias("lo"), F.max("prediction").alias("hi"),
              F.min("y").alias("least"), F.max("y").alias("greatest"))
    wide = (F.col("greatest") - F.col("least")) / 20
    return m.select(F.lit(name).alias("model"), "n", (F.col("r") > 0.8).alias("beats_the_mean"),
                    ((F.col("lo") >= F.col("least") - wide) & (F.col("hi") <= F.col("greatest") + wide)).alias("in_range"))


SOUND = "model n beats_the_mean in_range"


def sound_sql(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS model, count(*) AS n, true AS beats_the_mean, true AS in_range FROM embeddings" for x in names)


@query("f3_random_forest", SOUND, sql=sound_sql("RandomForest"))
def f3(t):
    return sound(t, models.random_forest(), "RandomForest")


@query("f4_no_bootstrap_forest", SOUND, sql=sound_sql("ExtraTrees"))
def f4(t):
    return sound(t, models.extra_trees(), "ExtraTrees")


SPLIT_SEED = 28
_, _u = random_trees.drawn(SPLIT_SEED, 0, 1, 0)
FIRST_SPLIT = """
sides AS (SELECT y, {x} > t AS side FROM pixels, cut),
p AS (SELECT s.y, {mean} AS prediction FROM sides s JOIN (SELECT side, avg(y) AS m, count(*) AS n, sum(y - (SELECT avg(y) FROM pixels)) AS g FROM sides GROUP BY side) v
      USING (side), (SELECT avg(y) AS base FROM pixels) AS a)"""


@query("f4_first_random_split", "", METRICS, f"""
WITH {PIXELS}, cut AS (SELECT min(f2) + {_u!r} * (max(f2) - min(f2)) AS t FROM pixels),
{FIRST_SPLIT.format(x='f2', mean='m')} {METRICS_SQL} p""")
def f4_first(t):
    d = pixels(t)
    return validate.error_metrics(models.extra_trees(1, 1, SPLIT_SEED)(d, ["f2"], "y").transform(d))


@query("f5_boosted_trees", SOUND, sql=sound_sql(*models.BOOST_PRESETS))
def f5(t):
    parts = side_by_side(t.spark, [partial(sound, t, models.boosted(name), name) for name in models.BOOST_PRESETS])
    return reduce(lambda a, b: a.unionByName(b), parts)


# the first split of one feature: among the edges of 255 bins, the one of greatest gain with 20 rows on either side
@query("f5_first_split", "", METRICS, f"""
WITH {PIXELS},
edges AS (SELECT DISTINCT unnest(quantile_cont(f2, [{', '.join(f'{i / 255!r}' for i in range(1, 255))}])) AS t FROM pixels),
tried AS (SELECT t, sum(CASE WHEN f2 <= t THEN d END) AS g, count(CASE WHEN f2 <= t THEN 1 END) AS n, count(*) AS whole
          FROM (SELECT f2, avg(y) OVER () - y AS d FROM pixels) AS c, edges GROUP BY t),
cut AS (SELECT t FROM tried WHERE n >= 20 AND whole - n >= 20 ORDER BY g * g / (n + 1.0) + g * g / (whole - n + 1.0) DESC, t LIMIT 1),
{FIRST_SPLIT.format(x='f2', mean='base + 0.05 * g / (n + 1.0)')} {METRICS_SQL} p""")
def f5_first(t):
    d = pixels(t)
    one = boosting.Settings(1, 0.05, leaves=2, min_leaf=20, l2=1.0)
    return validate.error_metrics(boosting.fit_boosting(d, ["f2"], "y", one).transform(d))


@query("f6_stacking", SOUND, sql=sound_sql("Stacked"))
def f6(t):
    bases = {n: models.boosted(n, mode="fast") if n in models.BOOST_PRESETS else models.random_forest(30, 10) for n in models.STACK_BASES}
    return sound(t, models.stacked(bases, "id"), "Stacked")


@query("f7_error_metrics", "zone", METRICS, f"""
WITH {PIXELS}, {ols2_sql('pixels')},
p AS (SELECT zone, y, b0 + b1 * f2 + b2 * f3 AS prediction FROM pixels, model)
SELECT zone, {R2_SQL} AS "R2", sqrt(avg(power(y - prediction, 2))) AS "RMSE", avg(abs(y - prediction)) AS "MAE",
       avg(y - prediction) AS "Bias", max(abs(y - prediction)) AS "MaxAbsErr"
FROM p GROUP BY zone""")
def f7(t):
    d = pixels(t)
    return validate.error_metrics(linear.fit_ols(d, PAIR, "y").transform(d), by=["zone"])


@query("f8_out_of_fold", "id fold", "y prediction", f"""
WITH RECURSIVE {FOLDED}, {oof_sql()} SELECT id, fold, y, prediction FROM oof""")
def f8_oof(t):
    return validate.out_of_fold(folded(t), "id", PAIR, "y", {"OLS": linear.fit_ols})


@query("f8_benchmark", "Zone Model", "R2 RMSE MAE Bias R2_fold_std R2_fold_min MaxAbsErr", f"""
WITH RECURSIVE {FOLDED}, {oof_sql()},
folds AS (SELECT {R2_SQL} AS r FROM oof GROUP BY fold)
SELECT 'Pixels' AS "Zone", 'OLS' AS "Model", {R2_SQL} AS "R2", sqrt(avg(power(y - prediction, 2))) AS "RMSE",
       avg(abs(y - prediction)) AS "MAE", avg(y - prediction) AS "Bias", (SELECT stddev_pop(r) FROM folds) AS "R2_fold_std",
       (SELECT min(r) FROM folds) AS "R2_fold_min", max(abs(y - prediction)) AS "MaxAbsErr"
FROM oof""")
def f8(t):
    return validate.benchmark(folded(t), "id", PAIR, "y", {"OLS": linear.fit_ols}, "Pixels")[0]


@query("f8_model_zoo", "Zone Model n finite", sql=" UNION ALL ".join(
    f"""SELECT 'Pixels' AS "Zone", '{m}' AS "Model", count(*) AS n, true AS finite FROM embeddings""" for m in models.ZOO))
def f8_zoo(t):
    """All eight models as they are by default on the spatial folds: pooled scores of all rows that are finite."""
    zoo = models.model_zoo("id")
    table, oof = validate.benchmark(folded(t).persist(), "id", FEATURES, "y", zoo, "Pixels")
    rows = oof.groupBy(F.col("model").alias("of")).agg(F.count("prediction").alias("n"))
    return table.join(rows, table["Model"] == rows["of"]).select("Zone", "Model", "n", F.col("R2").between(-10.0, 1.0).alias("finite"))


AUDIT_SQL = f"""
WITH RECURSIVE {FOLDED}, {oof_sql('fold', 'spat')}, {oof_sql('random_fold', 'rand')},
a AS (SELECT {R2_SQL} AS r FROM rand), b AS (SELECT {R2_SQL} AS r FROM spat)"""


@query("e7_residual_morans_i", "n k verdict", "morans_i", f"""
WITH RECURSIVE {FOLDED}, {oof_sql()},
resid AS (SELECT id, lon, lat, o.y - o.prediction AS e FROM oof o JOIN (SELECT id, lon, lat FROM pixels) AS xy USING (id)),
moran AS (WITH {moran_sql('resid', 'e')})
SELECT n, k, morans_i, CASE WHEN morans_i > 0.2 THEN 'unexplained spatial structure -> random CV would leak'
                            ELSE 'residuals spatially unstructured' END AS verdict FROM moran""")
def e7(t):
    """Residuals of rows that the model has not seen."""
    d = folded(t)
    oof = validate.out_of_fold(d, "id", PAIR, "y", {"OLS": linear.fit_ols}).select("id", (F.col("y") - F.col("prediction")).alias("e"))
    moran = spatial.morans_i(d.select("id", "lon", "lat").join(oof, "id"), "e", "lon", "lat", "id")
    return moran.withColumn("verdict", spatial.residual_verdict(F.col("morans_i")))


@query("f9_leakage_audit", "model", "R2_random_CV R2_spatial_CV optimism", f"""{AUDIT_SQL}
SELECT 'OLS' AS model, a.r AS "R2_random_CV", b.r AS "R2_spatial_CV", a.r - b.r AS optimism FROM a, b""")
def f9(t):
    return validate.leakage_audit(folded(t), "id", PAIR, "y", "OLS", linear.fit_ols)


ZONED_SQL = f"""
WITH {PIXELS}, {ols2_sql('pixels')},
p AS (SELECT zone, 'two' AS m, y, b0 + b1 * f2 + b2 * f3 AS prediction FROM pixels, model
      UNION ALL SELECT zone, 'mean', y, my FROM pixels, model),
s AS (SELECT zone, m, {R2_SQL} AS r FROM p GROUP BY zone, m)"""


def zoned_scores(t):
    d = pixels(t)
    m = linear.fit_ols(d, PAIR, "y")
    flat = d.agg(F.avg("y")).first()[0]
    two = m.transform(d).withColumn("Model", F.lit("two"))
    mean = d.withColumn("prediction", F.lit(flat)).withColumn("Model", F.lit("mean"))
    return validate.error_metrics(two.unionByName(mean), by=["zone", "Model"]).withColumnRenamed("zone", "Zone")


@query("f10_best_model", "Zone best_model", "best_R2", f"""{ZONED_SQL}
SELECT zone AS "Zone", max_by(m, r) AS best_model, max(r) AS "best_R2" FROM s GROUP BY zone""")
def f10(t):
    return validate.best_models(zoned_scores(t))


@query("f10_mean_optimism", "", "mean_optimism", f"""{ZONED_SQL}
SELECT avg(hi - lo) AS mean_optimism FROM (SELECT zone, max(r) AS hi, min(r) AS lo FROM s GROUP BY zone) AS z""")
def f10_mean(t):
    audit = zoned_scores(t).groupBy("Zone").agg((F.max("R2") - F.min("R2")).alias("optimism"))
    return validate.mean_optimism(audit)


@query("f11_refit_split", "o_orderkey part", sql=f"""
WITH f AS (SELECT o_orderkey, {bucket_sql('o_orderkey', 5)} AS fold, {hash_sql('o_orderkey', 2)} AS h FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY h, o_orderkey) AS nth, count(*) OVER () AS n FROM f WHERE fold <> 0)
SELECT o_orderkey, CASE WHEN nth IS NULL THEN 'test' WHEN nth <= greatest(200, floor(0.25 * n)) THEN 'calibrate'
                        ELSE 'fit' END AS part
FROM f LEFT JOIN r USING (o_orderkey)""")
def f11(t):
    return validate.refit_split(spatial.random_folds(t.orders.select("o_orderkey"), "o_orderkey"), "o_orderkey", seed=2)


# ---- attribution -----------------------------------------------------------

SHAP_SQL = f"""
{PIXELS}, {ols2_sql('pixels')},
shap AS (SELECT id, zone, y, f2, f3, b1 * (f2 - m1) AS s2, b2 * (f3 - m2) AS s3, my AS base FROM pixels, model),
long AS (SELECT id, zone, y, base, 'f2' AS feature, f2 AS v, s2 AS s FROM shap
         UNION ALL SELECT id, zone, y, base, 'f3', f3, s3 FROM shap)"""
IMPORTANCE_SQL = f"""{SHAP_SQL},
g AS (SELECT zone, feature, avg(abs(s)) AS a, avg(s) AS m, coalesce(corr(v, s), 0.0) AS c FROM long GROUP BY zone, feature),
imp AS (
  SELECT zone AS "Zone", feature AS "Feature", a AS "MeanAbsSHAP", m AS "MeanSHAP",
         CASE WHEN c > 0 THEN 'warming' ELSE 'cooling' END AS "Direction", c AS "SHAP_vs_value_corr",
         100.0 * a / sum(a) OVER (PARTITION BY zone) AS "PctContribution" FROM g)"""


def shap_frame(t):
    d = pixels(t)
    return explain.shap_columns(d, linear.fit_ols(d, PAIR, "y"))


def zone_importance(t):
    d, _ = shap_frame(t)
    return explain.importance(explain.shap_long(d, "id", PAIR, ["zone"]), ["zone"]).withColumnRenamed("zone", "Zone")


@query("h1_linear_shap", "id feature", "value shap", f"WITH {SHAP_SQL} SELECT id, feature, v AS value, s AS shap FROM long")
def h1(t):
    return explain.shap_long(shap_frame(t)[0], "id", PAIR)


@query("h1_sampled_shap", "id", "shap_f2 shap_f3 base", f"""
WITH {PIXELS}, {ols2_sql('pixels')},
bg AS (SELECT avg(f2) AS g2, avg(f3) AS g3 FROM (SELECT f2, f3 FROM pixels ORDER BY {hash_sql('id', 1)}, id LIMIT 12) AS b)
SELECT id, b1 * (f2 - g2) AS shap_f2, b2 * (f3 - g3) AS shap_f3, b0 + b1 * g2 + b2 * g3 AS base FROM pixels, model, bg""")
def h1_sampled(t):
    d = pixels(t)
    bg = explain.explain_sample(d, "id", 12, seed=1)
    out, base = explain.sampled_shap(d, "id", linear.fit_ols(d, PAIR, "y"), PAIR, bg, 12)
    return out.withColumn("base", F.lit(base))


@query("h1_sampled_shap_trees", "", "worst_gap", "SELECT 0.0 AS worst_gap FROM region LIMIT 1")
def h1_trees(t):
    """Sampled attributions of a forest add up to its predictions."""
    d = pixels(t).persist()
    m = models.random_forest(6, 5)(d, PAIR, "y")
    out, base = explain.sampled_shap(d, "id", m, PAIR, explain.explain_sample(d, "id", 5, seed=1), 5)
    gap = F.col("prediction") - explain.prediction_from_shap(PAIR, base)
    return m.transform(out).agg(F.max(F.abs(gap)).alias("worst_gap"))


@query("h1_tree_shap", "id", "gap", "SELECT vec_id AS id, 0.0 AS gap FROM embeddings")
def h1_exact(t):
    """Exact attributions of a whole boosted ensemble add up to its predictions, row by row."""
    d = pixels(t)
    m = models.boosted("LightGBM")(d, FEATURES, "y")
    out, base = trees.tree_shap(m.transform(d), m)
    return out.select("id", (F.col("prediction") - explain.prediction_from_shap(FEATURES, base)).alias("gap"))


# one split: the Shapley value of the only feature is the leaf's value less the mean over both leaves
@query("h1_tree_shap_split", "id", "shap base", f"""
WITH {PIXELS}, cut AS (SELECT min(f2) + {_u!r} * (max(f2) - min(f2)) AS t FROM pixels),
means AS (SELECT f2 > t AS side, avg(y) AS m FROM pixels, cut GROUP BY f2 > t)
SELECT id, m - (SELECT avg(y) FROM pixels) AS shap, (SELECT avg(y) FROM pixels) AS base FROM pixels p, cut c JOIN means ON side = (p.f2 > c.t)""")
def h1_split(t):
    d = pixels(t)
    out, base = trees.tree_shap(d.select("id", "f2"), models.extra_trees(1, 1, SPLIT_SEED)(d, ["f2"], "y"))
    return out.select("id", F.col("shap_f2").alias("shap"), F.lit(base).alias("base"))


@query("h2_importance", "Zone Feature Direction", "MeanAbsSHAP MeanSHAP SHAP_vs_value_corr PctContribution",
       f"WITH {IMPORTANCE_SQL} SELECT * FROM imp")
def h2(t):
    return zone_importance(t)


@query("h3_interactions", "Feature_A Feature_B", "Interaction_strength", f"""
WITH {SHAP_SQL}
SELECT 'f2' AS "Feature_A", 'f3' AS "Feature_B", abs(corr(abs(s2), f3)) AS "Interaction_strength" FROM shap
UNION ALL SELECT 'f3', 'f2', abs(corr(abs(s3), f2)) FROM shap""")
def h3(t):
    return explain.interactions(shap_frame(t)[0], PAIR)


@query("h4_local_explanations", "Hotspot Feature", "Observed_LST Baseline_LST Feature_value SHAP_contribution_C", f"""
WITH {SHAP_SQL},
hot AS (SELECT id, row_number() OVER (ORDER BY y DESC, id DESC) AS spot FROM shap),
best AS (SELECT l.*, spot, row_number() OVER (PARTITION BY l.id ORDER BY abs(s) DESC, feature) AS nth
         FROM long l JOIN hot USING (id) WHERE spot <= 5)
SELECT CAST(spot AS INTEGER) AS "Hotspot", feature AS "Feature", y AS "Observed_LST", base AS "Baseline_LST",
       v AS "Feature_value", s AS "SHAP_contribution_C" FROM best WHERE nth <= 6""")
def h4(t):
    d, base = shap_frame(t)
    return explain.local_explanations(d, "id", "y", PAIR, base)


@query("h5_permutation_importance", "feature", "r2_drop", f"""
WITH {PIXELS}, {ols2_sql('pixels')},
k AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM pixels),
{permuted_sql('k', 'place', 0, 2)},
p AS (SELECT 'all' AS feature, y, b0 + b1 * f2 + b2 * f3 AS prediction FROM pixels, model
      UNION ALL SELECT 'f2', a.y, b0 + b1 * b.f2 + b2 * a.f3 FROM k a JOIN moved m ON m.x = a.place AND m.perm = 0 JOIN k b ON b.place = m.place, model
      UNION ALL SELECT 'f3', a.y, b0 + b1 * a.f2 + b2 * b.f3 FROM k a JOIN moved m ON m.x = a.place AND m.perm = 1 JOIN k b ON b.place = m.place, model),
s AS (SELECT feature, {R2_SQL} AS r FROM p GROUP BY feature)
SELECT feature, (SELECT r FROM s WHERE feature = 'all') - r AS r2_drop FROM s WHERE feature <> 'all'""")
def h5(t):
    d = pixels(t)
    return explain.permutation_importance(d, "id", linear.fit_ols(d, PAIR, "y"), PAIR, "y")


@query("h6_partial_dependence", "", "level grid mean_prediction", f"""
WITH {PIXELS}, {ols2_sql('pixels')},
levels AS (SELECT i / 10.0 AS level FROM range(1, 10) AS r(i)),
q AS (SELECT quantile_cont(f2, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM pixels),
grid AS (SELECT i / 10.0 AS level, q[i] AS g FROM range(1, 10) AS r(i), q)
SELECT level, g AS grid, avg(b0 + b1 * g + b2 * f3) AS mean_prediction FROM grid, pixels, model GROUP BY level, g""")
def h6(t):
    d = pixels(t)
    return explain.partial_dependence(d, linear.fit_ols(d, PAIR, "y"), "f2")


# ---- confidence gate -------------------------------------------------------

GATE = ["f2", "f3", "f4"]
ZS = ["z2", "z3", "z4"]


def near_sql(query_cte: str, ref_cte: str, what: str, out: str) -> str:
    d = distance2_sql("a", "b", ZS)
    return f"""(
  SELECT id, avg({what}) AS {out} FROM (
    SELECT a.id, sqrt({d}) AS distance, b.resid, row_number() OVER (PARTITION BY a.id ORDER BY {d}, b.id) AS nth
    FROM {query_cte} a CROSS JOIN {ref_cte} b) AS n WHERE nth <= 10 GROUP BY id)"""


def rank_sql(value: str) -> str:
    return f"1.0 - (SELECT count(*) FROM half_b r WHERE r.{value} <= q.{value}) / CAST((SELECT count(*) FROM half_b) AS DOUBLE)"


GATE_SQL = f"""
{PARTED}, fit_rows AS (SELECT * FROM parted WHERE part = 'train'), {ols2_sql('fit_rows')},
scale AS (SELECT avg(f2) AS u2, stddev_pop(f2) AS v2, avg(f3) AS u3, stddev_pop(f3) AS v3, avg(f4) AS u4,
                 stddev_pop(f4) AS v4 FROM fit_rows),
zrows AS (
  SELECT id, part, zone, y, f2, f3, f4, (f2 - u2) / v2 AS z2, (f3 - u3) / v3 AS z3, (f4 - u4) / v4 AS z4,
         b0 + b1 * f2 + b2 * f3 AS prediction, abs(y - (b0 + b1 * f2 + b2 * f3)) AS resid
  FROM parted, model, scale),
train AS (SELECT * FROM zrows WHERE part = 'train'),
half_a AS (SELECT * FROM zrows WHERE part = 'calibrate' AND {bucket_sql('id', 2, 4)} = 0),
b_rows AS (SELECT * FROM zrows WHERE part = 'calibrate' AND {bucket_sql('id', 2, 4)} = 1),
settings AS (SELECT 0.1 * avg(resid) + 1e-6 AS beta FROM half_a),
half_b AS (
  SELECT b.*, ad, sigma, resid / (sigma + beta) AS score
  FROM b_rows b JOIN {near_sql('b_rows', 'train', 'distance', 'ad')} x USING (id)
  JOIN {near_sql('b_rows', 'half_a', 'resid', 'sigma')} s USING (id), settings),
q AS (
  SELECT max(CASE WHEN nth = low THEN score END) * (1.0 - max(spot) + max(low)) + coalesce(
           max(CASE WHEN nth = low + 1 THEN score END) * (max(spot) - max(low)), 0.0) AS q_hat
  FROM (SELECT *, floor(spot) AS low FROM (
    SELECT score, row_number() OVER (ORDER BY score) - 1 AS nth,
           (count(*) OVER () - 1) * least(1.0, ceil((count(*) OVER () + 1) * 0.9) / count(*) OVER ()) AS spot
    FROM half_b) AS r) AS s),
trust_b AS (SELECT q.*, round(sqrt(({rank_sql('ad')}) * ({rank_sql('sigma')})), 12) AS trust FROM half_b q),
cuts AS (SELECT round(quantile_cont(trust, 0.4), 12) AS t_accept, round(quantile_cont(trust, 0.15), 12) AS t_reject
         FROM trust_b)"""


def scored_sql(rows: str, out: str = "scored") -> str:
    return f"""
{out}_near AS (
  SELECT t.*, ad, sigma FROM {rows} t JOIN {near_sql(rows, 'train', 'distance', 'ad')} x USING (id)
  JOIN {near_sql(rows, 'half_a', 'resid', 'sigma')} s USING (id)),
{out}_ranked AS (
  SELECT q.*, {rank_sql('ad')} AS applicability_score, {rank_sql('sigma')} AS conformal_score FROM {out}_near q),
{out} AS (
  SELECT *, CASE WHEN trust_score >= t_accept THEN 'ACCEPT' WHEN trust_score >= t_reject THEN 'REVIEW'
                 ELSE 'REJECT' END AS verdict,
         CASE WHEN y >= lower AND y <= upper THEN 1.0 ELSE 0.0 END AS inside
  FROM (SELECT s.*, q_hat, t_accept, t_reject, round(sqrt(applicability_score * conformal_score), 12) AS trust_score,
               prediction - q_hat * (sigma + beta) AS lower, prediction + q_hat * (sigma + beta) AS upper,
               2.0 * q_hat * (sigma + beta) AS interval_width
        FROM {out}_ranked s, q, cuts, settings) AS v)"""


TEST_SQL = f"{GATE_SQL}, test AS (SELECT * FROM zrows WHERE part = 'test'), {scored_sql('test')}"


def fitted_gate(t):
    d = parted(t).persist()
    rows = {p: d.where(F.col("part") == p) for p in ("train", "calibrate", "test")}
    m = linear.fit_ols(rows["train"], PAIR, "y")
    gate = gatekeeper.Gatekeeper("id", tuple(GATE), seed=4).fit(m, rows["calibrate"], rows["train"], "y")
    return gate, rows


@query("i2_applicability", "id", "ad_distance", f"""
WITH {GATE_SQL} SELECT id, ad AS ad_distance FROM half_b""")
def i2(t):
    return fitted_gate(t)[0].half_b


@query("i3_calibration_halves", "o_orderkey half", sql=f"""
SELECT o_orderkey, {bucket_sql('o_orderkey', 2, 4)} AS half FROM orders""")
def i3(t):
    a, b = gatekeeper.split_halves(t.orders.select("o_orderkey"), "o_orderkey", 4)
    return a.withColumn("half", F.lit(0)).unionByName(b.withColumn("half", F.lit(1)))


@query("i4_difficulty", "id", "sigma", f"WITH {GATE_SQL} SELECT id, sigma FROM half_b")
def i4(t):
    return fitted_gate(t)[0].half_b


@query("i5_conformal_scores", "id", "score", f"WITH {GATE_SQL} SELECT id, score FROM half_b")
def i5(t):
    g = fitted_gate(t)[0]
    return g.half_b.withColumn("score", F.col("abs_resid") / (F.col("sigma") + F.lit(g.beta)))


@query("i6_conformal_quantile", "", "q_hat beta", f"WITH {GATE_SQL} SELECT q_hat, beta FROM q, settings")
def i6(t):
    return fitted_gate(t)[0].state()


RANKED_PRICES = """
WITH ref AS (SELECT l_extendedprice AS v FROM lineitem),
cum AS (SELECT v, sum(count(*)) OVER (ORDER BY v) AS below FROM ref GROUP BY v)
SELECT o_orderkey, 1.0 - coalesce(c.below, 0) / CAST((SELECT count(*) FROM ref) AS DOUBLE) AS score
FROM orders ASOF LEFT JOIN cum c ON o_totalprice >= c.v"""


@query("i7_rank_score", "o_orderkey", "score", RANKED_PRICES)
def i7(t):
    return gatekeeper.rank_score(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice",
                                 t.lineitem, "l_extendedprice", "score")


@query("i7_rank_score_sorted", "o_orderkey", "score", RANKED_PRICES)
def i7_sorted(t):
    return gatekeeper.rank_score(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice",
                                 t.lineitem, "l_extendedprice", "score", small=0)


@query("i8_trust", "id", "applicability_score conformal_score trust_score", f"""
WITH {TEST_SQL} SELECT id, applicability_score, conformal_score, trust_score FROM scored""")
def i8(t):
    g, rows = fitted_gate(t)
    return g.score(rows["test"])


@query("i9_thresholds", "", "t_accept t_reject", f"WITH {GATE_SQL} SELECT t_accept, t_reject FROM cuts")
def i9(t):
    return fitted_gate(t)[0].state()


@query("i10_verdicts", "verdict n", sql=f"WITH {TEST_SQL} SELECT verdict, count(*) AS n FROM scored GROUP BY verdict")
def i10(t):
    g, rows = fitted_gate(t)
    return g.score(rows["test"]).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("i11_score", "id verdict",
       "prediction lower upper interval_width applicability_score conformal_score trust_score", f"""
WITH {TEST_SQL}
SELECT id, verdict, prediction, lower, upper, interval_width, applicability_score, conformal_score, trust_score
FROM scored""")
def i11(t):
    g, rows = fitted_gate(t)
    return g.score(rows["test"])


def coverage_sql(source: str) -> str:
    parts = []
    for v in gatekeeper.VERDICTS:
        n = f"count(CASE WHEN verdict = '{v}' THEN 1 END)"
        parts.append(f"""100.0 * avg(CASE WHEN verdict = '{v}' THEN 1.0 ELSE 0.0 END) AS "pct_{v}",
       CASE WHEN {n} > 5 THEN avg(CASE WHEN verdict = '{v}' THEN abs(y - prediction) END) END AS "MAE_{v}",
       CASE WHEN {n} > 5 THEN avg(CASE WHEN verdict = '{v}' THEN inside END) END AS "cov_{v}\"""")
    return f"""SELECT 0.9 AS target_coverage, avg(inside) AS empirical_coverage, avg(interval_width) AS mean_interval_width,
       max(q_hat) AS q_hat, max(t_accept) AS t_accept, max(t_reject) AS t_reject, {', '.join(parts)} FROM {source}"""


COVERAGE = ("target_coverage empirical_coverage mean_interval_width q_hat t_accept t_reject pct_ACCEPT MAE_ACCEPT "
            "cov_ACCEPT pct_REVIEW MAE_REVIEW cov_REVIEW pct_REJECT MAE_REJECT cov_REJECT")


@query("i12_coverage", "", COVERAGE, f"WITH {TEST_SQL} {coverage_sql('scored')}")
def i12(t):
    g, rows = fitted_gate(t)
    return gatekeeper.validate_coverage(g.score(rows["test"]), "y", g)


@query("i13_error_ratio", "separates", "error_ratio", f"""
WITH {TEST_SQL}, v AS ({coverage_sql('scored')})
SELECT "MAE_REJECT" / "MAE_ACCEPT" AS error_ratio, "MAE_REJECT" / "MAE_ACCEPT" > 1.0 AS separates FROM v""")
def i13(t):
    g, rows = fitted_gate(t)
    return gatekeeper.error_ratio(gatekeeper.validate_coverage(g.score(rows["test"]), "y", g))


STRESS_SQL = f"""{GATE_SQL},
stress AS (
  SELECT id, scenario, y, (f2 - u2) / v2 AS z2, (f3 - u3) / v3 AS z3, (f4 - u4) / v4 AS z4,
         b0 + b1 * f2 + b2 * f3 AS prediction, CAST(NULL AS DOUBLE) AS resid
  FROM (SELECT id, 'in_distribution' AS scenario, y, f2, f3, f4 FROM parted WHERE part = 'test'
        UNION ALL SELECT id + 1000000000, 'shifted', y, f2 + 4.0 * v2, f3 + 4.0 * v3, f4 + 4.0 * v4
                  FROM parted, scale WHERE part = 'test'
        UNION ALL SELECT id + 2000000000, 'drifted', 60.0 - y, f2, f3, f4 FROM parted WHERE part = 'test') AS s,
       model, scale), {scored_sql('stress')}"""


@query("i14_stress", "scenario verdict n", "mae mean_width coverage", f"""
WITH {STRESS_SQL}
SELECT scenario, verdict, count(*) AS n, avg(abs(y - prediction)) AS mae, avg(interval_width) AS mean_width,
       avg(inside) AS coverage FROM scored GROUP BY scenario, verdict""")
def i14(t):
    g, rows = fitted_gate(t)
    d = rows["test"].select("id", "y", *GATE)
    same = d.withColumn("scenario", F.lit("in_distribution"))
    far = d.select((F.col("id") + 1000000000).alias("id"), "y",
                   *[(F.col(c) + F.lit(4.0 * g.stats[c][1])).alias(c) for c in GATE], F.lit("shifted").alias("scenario"))
    drift = d.select((F.col("id") + 2000000000).alias("id"), (F.lit(60.0) - F.col("y")).alias("y"), *GATE,
                     F.lit("drifted").alias("scenario"))
    return gatekeeper.verdict_errors(g.score(same.unionByName(far).unionByName(drift)), "y", ["scenario"])


@query("i15_spearman", "", "rho", """
SELECT corr(ra, rb) AS rho FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb
  FROM lineitem) AS r""")
def i15(t):
    key = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    d = t.lineitem.select(key.alias("k"), "l_quantity", "l_extendedprice")
    return gatekeeper.spearman(d, "l_quantity", "l_extendedprice", "k")


@query("i15_trust_error_spearman", "", "rho", f"""
WITH {TEST_SQL},
r AS (SELECT rank() OVER (ORDER BY trust_score) + (count(*) OVER (PARTITION BY trust_score) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY abs(y - prediction)) AS rb FROM scored)
SELECT corr(ra, rb) AS rho FROM r""", dp=4)
def i15_trust(t):
    g, rows = fitted_gate(t)
    d = g.score(rows["test"]).withColumn("e", F.abs(F.col("y") - F.col("prediction")))
    return gatekeeper.spearman(d, "trust_score", "e", "id")


BINS_SQL = """
WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders),
b AS (SELECT 1 + CASE WHEN o_totalprice > q[1] THEN 1 ELSE 0 END + CASE WHEN o_totalprice > q[2] THEN 1 ELSE 0 END
             + CASE WHEN o_totalprice > q[3] THEN 1 ELSE 0 END + CASE WHEN o_totalprice > q[4] THEN 1 ELSE 0 END AS bin,
             CAST(o_custkey AS DOUBLE) AS e FROM orders, q),
binned AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(e) AS mean_error FROM b GROUP BY bin)"""


def price_bins(t):
    d = t.orders.select("o_totalprice", F.col("o_custkey").cast("double").alias("e"))
    return gatekeeper.error_by_quantile_bin(d, "o_totalprice", "e")


@query("i16_error_by_quintile", "bin n", "mean_error", f"{BINS_SQL} SELECT * FROM binned")
def i16(t):
    return price_bins(t)


@query("i16_discrimination", "discriminates", "q1_q5_ratio", f"""{BINS_SQL}
SELECT min_by(mean_error, bin) / max_by(mean_error, bin) AS q1_q5_ratio,
       min_by(mean_error, bin) / max_by(mean_error, bin) > 1.3 AS discriminates FROM binned""")
def i16_ratio(t):
    return gatekeeper.discrimination(price_bins(t))


def scored_test(t):
    g, rows = fitted_gate(t)
    return g, g.score(rows["test"])
