"""Differences between two zones, paired by place in the target's order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.functions.ranking import global_rank

MIN_ROWS = 100


def rank_aligned(a: DataFrame, b: DataFrame, lst: str, features: list[str], key: str,
                 by_share: bool = False) -> DataFrame:
    """``rank, d_LST, d_<feature>`` (b minus a) of rows with equal rank.

    The larger zone gives its coolest rows; ``by_share`` pairs equal shares of
    both distributions instead.
    """
    def ranked(df, name):
        d = df.select(F.col(f"`{lst}`").alias("y"), F.col(key).alias("k"), *[F.col(f"`{c}`") for c in features])
        d = global_rank(d.where("y is not null"), ["y", "k"], out="r")
        return d.select("r", *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in ("y", *features)])

    left, right = ranked(a, "a"), ranked(b, "b")
    if by_share:
        na, nb = left.count(), right.count()
        if na == 0 or nb == 0:
            return left.join(right, "r")
        # row r of the smaller zone meets the row at the same share of the larger one
        small, n_small, large, n_large = (left, na, right, nb) if na <= nb else (right, nb, left, na)
        at = F.floor(F.col("r") * F.lit((n_large - 1) / max(n_small - 1, 1)) + 0.5).cast("long")
        paired = small.withColumn("at", at).join(large.withColumnRenamed("r", "at"), "at")
    else:
        paired = left.join(right, "r")
    return paired.select(F.col("r").alias("rank"), (F.col("b_y") - F.col("a_y")).alias("d_LST"),
                         *[(F.col(f"`b_{c}`") - F.col(f"`a_{c}`")).alias(f"d_{c}") for c in features])


def change_drivers(aligned: DataFrame, features: list[str], comparison: str, fit) -> DataFrame | None:
    """Importance of each difference for the target's difference, from one boosted model.

    ``fit`` is a fitter from :mod:`heatscape.operators.models` whose models
    expose feature importances.
    """
    if aligned.limit(MIN_ROWS).count() < MIN_ROWS or len(features) < 2:
        return None
    names = [f"d_{c}" for c in features]
    model = fit(aligned, names, "d_LST")
    from heatscape.functions.columns import r2

    score = model.transform(aligned).agg(r2("d_LST", "prediction").alias("r")).first()["r"]
    weights = [float(x) for x in model.importances()]
    total = sum(weights) or 1.0
    rows = [(n, w, 100.0 * w / total, comparison, round(score, 4)) for n, w in zip(names, weights)]
    return aligned.sparkSession.createDataFrame(
        rows, "Delta_feature string, Importance double, Pct double, Comparison string, Model_R2_insample double"
    ).orderBy(F.desc("Pct"))
