"""Attribution of predictions to features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.functions.columns import add, r2
from heatscape.functions.permutation import permuted
from heatscape.functions.ranking import column_quantiles, global_rank
from heatscape.operators.clean import hash_sample
from heatscape.operators.linear import LinearModel


def shap_columns(df: DataFrame, model: LinearModel) -> tuple[DataFrame, float]:
    """Exact values of a linear model: slope times distance from the mean.

    Returns the frame with ``shap_<feature>`` and the base value.
    """
    r = df.agg(*[F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(model.features)]).first()
    means = [r[f"m{i}"] for i in range(len(model.features))]
    base = model.intercept + float(np.dot(model.coef, means))
    return df.withColumns({
        f"shap_{f}": (F.col(f"`{f}`") - F.lit(means[i])) * F.lit(float(model.coef[i]))
        for i, f in enumerate(model.features)}), base


def sampled_shap(df: DataFrame, key: str, model, features: list[str], background: DataFrame,
                 permutations: int = 10, seed: int = 42) -> tuple[DataFrame, float]:
    """Shapley values of any model with ``transform``, by sampled feature orders.

    Every row walks each feature order from a background row to itself; the
    change in prediction at a step belongs to the feature switched on there.
    The background is a small sample (at most 100 rows) held as literals.
    Values and base add up to the prediction exactly.
    """
    bg = background.select(*features).limit(101).collect()
    if len(bg) > 100:
        raise ValueError("give a background of at most 100 rows")
    rng = np.random.default_rng(seed)
    walks = [(b, rng.permutation(len(features))) for b in bg for _ in range(max(1, permutations // len(bg)))]
    p = len(features)
    steps = len(walks) * (p + 1)
    d = df.select(key, *[F.col(f"`{f}`").alias(f"__x{i}") for i, f in enumerate(features)],
                  F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("__step"))
    at = F.col("__step") + 1
    place = {i: [int(np.flatnonzero(order == i)[0]) for _, order in walks for _ in range(p + 1)] for i in range(p)}
    stage = [s for _ in walks for s in range(p + 1)]

    def pick(values, kind):
        return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), at)

    mixed = {}
    for i, f in enumerate(features):
        own = pick(place[i], "int") < pick(stage, "int")
        other = pick([float(b[i]) for b, _ in walks for _ in range(p + 1)], "double")
        mixed[f] = F.when(own, F.col(f"__x{i}")).otherwise(other)
    scored = model.transform(d.withColumns(mixed)).select(key, "__step", "prediction")
    # feature switched on between stage s-1 and s gains f(s) and loses f(s-1)
    turned = [int(order[s - 1]) if s else -1 for _, order in walks for s in range(p + 1)]
    following = [int(order[s]) if s < p else -1 for _, order in walks for s in range(p + 1)]
    y = F.col("prediction") / float(len(walks))
    shap = scored.groupBy(key).agg(*[
        F.sum(F.when(pick(turned, "int") == i, y).otherwise(0.0)
              - F.when(pick(following, "int") == i, y).otherwise(0.0)).alias(f"shap_{f}")
        for i, f in enumerate(features)])
    bg_frame = df.sparkSession.createDataFrame([tuple(map(float, b)) for b, _ in walks],
                                               ", ".join(f"`{f}` double" for f in features))
    base = model.transform(bg_frame).agg(F.avg("prediction")).first()[0]
    return df.join(shap, key), float(base)


def shap_long(df: DataFrame, key: str, features: list[str], keep: list[str] = ()) -> DataFrame:
    """``key, feature, value, shap`` rows of a frame with shap columns."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"), F.col(f"`shap_{f}`").alias("shap"))
        for f in features]))
    return df.select(key, *keep, cells.alias("c")).select(key, *keep, "c.*")


def corr_or_zero(a: Column, b: Column) -> Column:
    """Pearson correlation; 0 when a side is constant."""
    ok = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, F.corr(a, b)).otherwise(0.0)


def importance(long: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean absolute and signed value, direction and share per feature."""
    by = list(by)
    d = long.groupBy(*by, "feature").agg(
        F.avg(F.abs("shap")).alias("MeanAbsSHAP"), F.avg("shap").alias("MeanSHAP"),
        corr_or_zero(F.col("value"), F.col("shap")).alias("SHAP_vs_value_corr"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row per feature by now
    return d.select(*by, F.col("feature").alias("Feature"), "MeanAbsSHAP", "MeanSHAP",
                    F.when(F.col("SHAP_vs_value_corr") > 0, "warming").otherwise("cooling").alias("Direction"),
                    "SHAP_vs_value_corr",
                    (100.0 * F.col("MeanAbsSHAP") / F.sum("MeanAbsSHAP").over(whole)).alias("PctContribution"))


def interactions(df: DataFrame, features: list[str], top: int | None = 15) -> DataFrame:
    """|corr(|shap of A|, value of B)| for ordered pairs, all in one aggregate over the rows."""
    pairs = [(a, b) for a in features for b in features if a != b]
    r = df.agg(*[F.abs(corr_or_zero(F.abs(f"`shap_{a}`"), F.col(f"`{b}`"))).alias(f"p{i}")
                 for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("Feature_A"), F.lit(b).alias("Feature_B"), F.col(f"p{i}").alias("Interaction_strength"))
        for i, (a, b) in enumerate(pairs)]))
    out = r.select(cells.alias("c")).select("c.*")
    if top is None:
        return out
    return out.orderBy(F.desc("Interaction_strength"), "Feature_A", "Feature_B").limit(top)


def local_explanations(df: DataFrame, key: str, y: str, features: list[str], base: float,
                       n_rows: int = 5, n_features: int = 6) -> DataFrame:
    """Largest attributions of the hottest rows."""
    hottest = df.orderBy(F.desc(f"`{y}`"), F.desc(key)).limit(n_rows)
    w = W.partitionBy(F.lit(0)).orderBy(F.desc(f"`{y}`"), F.desc(key))  # n_rows rows
    d = hottest.withColumn("Hotspot", F.row_number().over(w))
    long = shap_long(d, key, features, ["Hotspot", y])
    best = W.partitionBy("Hotspot").orderBy(F.desc(F.abs("shap")), "feature")
    return (long.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= n_features)
            .select("Hotspot", F.col(f"`{y}`").alias("Observed_LST"), F.lit(base).alias("Baseline_LST"),
                    F.col("feature").alias("Feature"), F.col("value").alias("Feature_value"),
                    F.col("shap").alias("SHAP_contribution_C")))


def permuted_columns(df: DataFrame, key: str, columns: list[str], seed: int = 0) -> DataFrame:
    """``key`` and ``moved_<i>``: the values of each column moved to other rows, by a permutation of its own.

    Places are those by key; value number p of column i goes to place ``permuted(p)`` with seed + i.  One rank
    and one shuffle serve all columns.
    """
    d = df.select(F.col(key).alias("__k"), *[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)])
    n = d.count()
    placed = global_rank(d, ["__k"], out="place")
    moves = F.array(*[F.struct(F.lit(i).alias("i"), permuted(F.col("place"), n, seed + i).alias("to"), F.col(f"v{i}").cast("double").alias("v"))
                      for i in range(len(columns))])
    arrived = placed.select(F.explode(moves).alias("m")).groupBy(F.col("m.to").alias("place")).agg(
        *[F.max(F.when(F.col("m.i") == i, F.col("m.v"))).alias(f"moved_{i}") for i in range(len(columns))])
    return placed.join(arrived, "place").select(F.col("__k").alias(key), *[f"moved_{i}" for i in range(len(columns))])


def permutation_importance(df: DataFrame, key: str, model, features: list[str], y: str, seed: int = 0) -> DataFrame:
    """Loss of R2 when one feature is permuted; all features are scored in one pass."""
    d = model.transform(df.join(permuted_columns(df, key, features, seed), key)).withColumnRenamed("prediction", "__whole")
    for i, f in enumerate(features):
        swapped = d.withColumns({"__own": F.col(f"`{f}`"), f: F.col(f"moved_{i}")})
        d = model.transform(swapped).withColumnRenamed("prediction", f"__without_{i}").withColumn(f, F.col("__own")).drop("__own")
    scores = d.agg(r2(y, "__whole").alias("whole"), *[r2(y, f"__without_{i}").alias(f"r{i}") for i in range(len(features))])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("whole") - F.col(f"r{i}")).alias("r2_drop")) for i, f in enumerate(features)]))
    return scores.select(cells.alias("c")).select("c.*")


def partial_dependence(df: DataFrame, model, feature: str, levels: list[float] | None = None) -> DataFrame:
    """Mean prediction with ``feature`` set to each of a few of its quantiles."""
    levels = levels or [i / 10 for i in range(1, 10)]
    grid = column_quantiles(df, {feature: levels})[feature]
    points = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("level"), F.lit(float(g)).alias("grid"))
                                 for a, g in zip(levels, grid)]))
    d = df.withColumn("__g", points).withColumn(feature, F.col("__g.grid"))
    return model.transform(d).groupBy(F.col("__g.level").alias("level"), F.col("__g.grid").alias("grid")).agg(
        F.avg("prediction").alias("mean_prediction"))


def explain_sample(df: DataFrame, key: str, max_rows: int = 4000, seed: int = 0) -> DataFrame:
    return hash_sample(df, key, max_rows, seed)


def prediction_from_shap(features: list[str], base: float) -> Column:
    return add([F.lit(base), *[F.col(f"`shap_{f}`") for f in features]])
