"""Conformal intervals and an accept / review / reject verdict per prediction.

Two signals are joined: how far a row lies from the training rows, and how
large the residuals of its nearest calibration rows are.  Both become ranks
against held-out calibration rows, trust is their geometric mean, and the
thresholds are quantiles of trust on the same held-out rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.functions.columns import hash_bucket
from heatscape.functions.ranking import global_rank, quantile_values, quantiles
from heatscape.operators.clean import scaling_stats, standardise
from heatscape.operators.neighbours import knn_mean

VERDICTS = ("ACCEPT", "REVIEW", "REJECT")
SMALL_SCALE = 1_000_000
# Trust takes few distinct values, so a threshold often equals one of them; the
# last bits of a product of two ranks must not decide such a tie.
TRUST_DIGITS = 12


def conformal_level(m: int, alpha: float) -> float:
    return min(1.0, math.ceil((m + 1) * (1 - alpha)) / m)


def rank_score(df: DataFrame, key: str, value: str, ref: DataFrame, ref_value: str, out: str,
               small: int = SMALL_SCALE) -> DataFrame:
    """Add 1 - share of reference values <= ``value``, null for null; 0.5 without reference values.

    Up to ``small`` reference values are broadcast as one sorted array.  Beyond
    that both tables are sorted together: the place of a row among all, less
    its place among the queries, is the number of reference values before it.
    """
    r = ref.select(F.col(ref_value).cast("double").alias("v")).where("v is not null")
    n = r.count()
    if n == 0:
        return df.withColumn(out, F.lit(0.5))
    if n <= small:
        bc = df.sparkSession.sparkContext.broadcast(np.sort(r.toPandas()["v"].to_numpy()))

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            return pd.Series(1.0 - np.searchsorted(bc.value, v.to_numpy(), side="right") / len(bc.value))

        return df.withColumn(out, F.when(F.col(value).isNotNull(), score(F.col(value))))
    q = df.select(F.col(value).alias("v"), F.lit(1).alias("t"), F.col(key).cast("long").alias("k"))
    # reference rows get a number, so that equal values can be in several tasks
    both = q.unionByName(r.select("v", F.lit(0).alias("t"), F.monotonically_increasing_id().alias("k")))
    everywhere = global_rank(both, ["v", "t", "k"]).where("t = 1").select("k", F.col("rank").alias("a"))
    among = global_rank(q, ["v", "t", "k"]).select("k", F.col("rank").alias("b"))
    below = everywhere.join(among, "k").select(
        F.col("k").alias(key), (1.0 - (F.col("a") - F.col("b")) / F.lit(float(n))).alias("__below"))
    scored = df.join(below, key)
    return scored.withColumn(out, F.when(F.col(value).isNotNull(), F.col("__below"))).drop("__below")


@dataclass
class GatekeeperModel:
    key: str
    features: list
    model: object
    stats: dict
    alpha: float
    k: int
    beta: float
    q_hat: float
    t_accept: float
    t_reject: float
    train: DataFrame = field(repr=False)
    half_a: DataFrame = field(repr=False)
    half_b: DataFrame = field(repr=False)

    def score(self, df: DataFrame) -> DataFrame:
        """Input columns plus prediction, interval, both scores, trust and verdict.

        A row without a feature has no neighbours: its interval and scores are null and its verdict is REJECT.
        """
        d = standardise(self.model.transform(df), self.features, self.stats)
        d = _signals(d, self.key, self.features, self.train, self.half_a, self.k, "left")
        d = rank_score(d, self.key, "ad_distance", self.half_b, "ad_distance", "applicability_score")
        d = rank_score(d, self.key, "sigma", self.half_b, "sigma", "conformal_score")
        half = F.lit(self.q_hat) * (F.col("sigma") + F.lit(self.beta))
        trust = trust_score(F.col("applicability_score"), F.col("conformal_score"))
        d = d.withColumns({"lower": F.col("prediction") - half, "upper": F.col("prediction") + half,
                           "interval_width": half * 2.0, "trust_score": trust})
        d = d.withColumn("verdict", verdict(F.col("trust_score"), self.t_accept, self.t_reject))
        return d.drop(*[f"z_{c}" for c in self.features], "ad_distance", "sigma")

    def state(self) -> DataFrame:
        return self.train.sparkSession.createDataFrame(
            [(self.alpha, self.k, self.beta, self.q_hat, self.t_accept, self.t_reject)],
            "alpha double, k int, beta double, q_hat double, t_accept double, t_reject double")


def trust_score(ad: Column, conf: Column) -> Column:
    return F.round(F.sqrt(ad * conf), TRUST_DIGITS)


def verdict(trust: Column, t_accept: float, t_reject: float) -> Column:
    return F.when(trust >= t_accept, "ACCEPT").when(trust >= t_reject, "REVIEW").otherwise("REJECT")


def _mean_near(q: DataFrame, key: str, zs: list[str], ref: DataFrame, k: int, value: str | None, out: str):
    return knn_mean(q, ref, zs, k, key, value=value).select(F.col("query_id").alias(key), F.col("mean").alias(out))


def _signals(df: DataFrame, key: str, features: list[str], train: DataFrame, half_a: DataFrame, k: int,
             how: str = "inner") -> DataFrame:
    """Add mean distance to the k nearest training rows and mean residual of the k nearest A rows."""
    zs = [f"z_{c}" for c in features]
    return (df.join(_mean_near(df, key, zs, train, k, None, "ad_distance"), key, how)
            .join(_mean_near(df, key, zs, half_a, k, "abs_resid", "sigma"), key, how))


def split_halves(cal: DataFrame, key: str, seed: int = 0, min_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Half A estimates difficulty, half B the quantile; both are all rows if one is too small."""
    half = hash_bucket(key, 2, seed)
    a, b = cal.where(half == 0), cal.where(half == 1)
    r = cal.agg(F.count_if(half == 0).alias("a"), F.count_if(half == 1).alias("b")).first()
    return (cal, cal) if min(r["a"], r["b"]) < min_rows else (a, b)


@dataclass(frozen=True)
class Gatekeeper:
    """Settings; ``fit`` takes any model with ``transform`` adding ``prediction``."""

    key: str
    features: tuple
    alpha: float = 0.10
    k: int = 10
    accept_q: float = 0.40
    reject_q: float = 0.15
    seed: int = 0

    def fit(self, model, cal: DataFrame, train: DataFrame, y: str) -> GatekeeperModel:
        feats = list(self.features)
        stats = scaling_stats(train, feats)
        zs = [f"z_{c}" for c in feats]
        train_z = standardise(train, feats, stats).select(self.key, *zs)
        cal_z = standardise(model.transform(cal), feats, stats).withColumn(
            "abs_resid", F.abs(F.col(f"`{y}`") - F.col("prediction"))).select(self.key, *zs, "abs_resid")
        a, b = split_halves(cal_z, self.key, self.seed)
        beta = 0.1 * a.agg(F.avg("abs_resid")).first()[0] + 1e-6
        b = _signals(b, self.key, feats, train_z, a, self.k).select(self.key, "abs_resid", "ad_distance", "sigma")
        b = b.persist()
        m = b.count()
        scores = b.select((F.col("abs_resid") / (F.col("sigma") + F.lit(beta))).alias("s"))
        q_hat = quantile_values(scores, "s", [conformal_level(m, self.alpha)], rows=m)[0]
        d = rank_score(b, self.key, "ad_distance", b, "ad_distance", "ad")
        d = rank_score(d, self.key, "sigma", b, "sigma", "conf")
        trust = d.select(trust_score(F.col("ad"), F.col("conf")).alias("t"))
        t_accept, t_reject = (round(x, TRUST_DIGITS) for x in
                              quantile_values(trust, "t", [self.accept_q, self.reject_q], rows=m))
        return GatekeeperModel(self.key, feats, model, stats, self.alpha, self.k, beta, q_hat, t_accept, t_reject,
                               train_z, a, b)


def validate_coverage(scored: DataFrame, y: str, model: GatekeeperModel, by: list[str] = ()) -> DataFrame:
    """Coverage, width and verdict mix in one aggregate; error per verdict above five rows."""
    e = F.abs(F.col(f"`{y}`") - F.col("prediction"))
    inside = F.when((F.col(f"`{y}`") >= F.col("lower")) & (F.col(f"`{y}`") <= F.col("upper")), 1.0).otherwise(0.0)
    aggs = [F.avg(inside).alias("empirical_coverage"), F.avg("interval_width").alias("mean_interval_width")]
    for v in VERDICTS:
        is_v = F.col("verdict") == v
        n = F.count_if(is_v)
        aggs += [(100.0 * F.avg(F.when(is_v, 1.0).otherwise(0.0))).alias(f"pct_{v}"),
                 F.when(n > 5, F.avg(F.when(is_v, e))).alias(f"MAE_{v}"),
                 F.when(n > 5, F.avg(F.when(is_v, inside))).alias(f"cov_{v}")]
    out = scored.groupBy(*by).agg(*aggs)
    return out.select(*by, F.lit(1 - model.alpha).alias("target_coverage"), "empirical_coverage",
                      "mean_interval_width", F.lit(model.q_hat).alias("q_hat"),
                      F.lit(model.t_accept).alias("t_accept"), F.lit(model.t_reject).alias("t_reject"),
                      *[c for c in out.columns if c[:4] in ("pct_", "MAE_", "cov_")])


def error_ratio(validation: DataFrame) -> DataFrame:
    """REJECT over ACCEPT error, with a flag only when the gate separates them."""
    ratio = F.col("MAE_REJECT") / F.col("MAE_ACCEPT")
    return validation.withColumn("error_ratio", ratio).withColumn("separates", ratio > 1.0)


def verdict_errors(scored: DataFrame, y: str, by: list[str] = ()) -> DataFrame:
    """Rows, share, error, width and coverage per scenario and verdict."""
    e = F.abs(F.col(f"`{y}`") - F.col("prediction"))
    inside = F.when((F.col(f"`{y}`") >= F.col("lower")) & (F.col(f"`{y}`") <= F.col("upper")), 1.0).otherwise(0.0)
    return scored.groupBy(*by, "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), F.avg("interval_width").alias("mean_width"),
        F.avg(inside).alias("coverage"))


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rank correlation with averaged ties, for tables of any size."""
    d = df.select(F.col(key).alias("__k"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    for c in ("__a", "__b"):
        ranked = global_rank(d, [c, "__k"], out="__rank")
        # a group of equal values shrinks to its first and last place first
        ties = ranked.groupBy(c).agg(((F.min("__rank") + F.max("__rank")) / 2.0).alias(f"r{c}"))
        d = ranked.drop("__rank").join(ties, c)
    return d.agg(F.corr("r__a", "r__b").alias("rho"))


def error_by_quantile_bin(df: DataFrame, score: str, error: str, bins: int = 5) -> DataFrame:
    """Mean error per right-closed quantile bin of ``score``; equal edges are merged."""
    edges = quantiles(df, score, [i / bins for i in range(bins + 1)]).first()["q"]
    edges = sorted(set(edges))
    c = F.lit(1)
    for e in edges[1:-1]:
        c = c + F.when(F.col(score) > e, 1).otherwise(0)
    return df.withColumn("bin", c.cast("int")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"))


def discrimination(binned: DataFrame, limit: float = 1.3) -> DataFrame:
    """Error of the least trusted bin over the most trusted one."""
    ratio = F.min_by("mean_error", "bin") / F.max_by("mean_error", "bin")
    return binned.agg(ratio.alias("q1_q5_ratio")).withColumn("discriminates", F.col("q1_q5_ratio") > limit)
