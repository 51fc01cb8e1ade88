"""Spatial blocks, folds and autocorrelation."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.functions.columns import hash_bucket, squared_distance
from heatscape.operators.clean import hash_sample, scaling_stats, standardise
from heatscape.operators.neighbours import knn_mean

# Fixed values of the validation design.
N_BLOCKS = 10
N_FOLDS = 5
MORAN_NEIGHBOURS = 8
MORAN_MIN_ROWS = 20
RESIDUAL_LIMIT = 0.2
LEAKS = "unexplained spatial structure -> random CV would leak"
CLEAN = "residuals spatially unstructured"


def fit_centres(df: DataFrame, cols: list[str], k: int, seed: int = 42, max_iter: int = 20) -> np.ndarray:
    """k-means centres of the given numeric columns; k x p numbers."""
    vec = VectorAssembler(inputCols=cols, outputCol="__v", handleInvalid="skip").transform(df.select(*cols))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initSteps=2, featuresCol="__v").fit(vec.select("__v"))
    return np.array(model.clusterCenters())


def nearest_centre(cols: list[str], centres) -> Column:
    """Number of the closest centre (ties to the lower number) as an expression."""
    options = [F.struct(squared_distance([F.col(f"`{c}`") for c in cols], [F.lit(float(v)) for v in centre]).alias("d"),
                        F.lit(i).alias("i")) for i, centre in enumerate(centres)]
    return F.array_min(F.array(*options))["i"] if len(options) > 1 else F.lit(0)


def spatial_blocks(df: DataFrame, lon: str | None, lat: str | None, features: list[str], key: str,
                   n_blocks: int = N_BLOCKS, seed: int = 42) -> tuple[DataFrame, str]:
    """Add ``block``: k-means on coordinates, else on features, else key order modulo."""
    if lon and lat:
        cols, how = [lat, lon], "spatial-blocked (k-means on coordinates)"
    elif features:
        cols, how = features, "feature-space blocked (no coordinates present)"
    else:
        return row_blocks(df, key, n_blocks), "random k-fold (no blocking possible)"
    # a missing coordinate takes the mean of its own axis
    stats = scaling_stats(df, cols)
    z = standardise(df.fillna({c: stats[c][0] for c in cols}), cols, stats)
    zc = [f"z_{c}" for c in cols]
    z = z.withColumn("block", nearest_centre(zc, fit_centres(z, zc, n_blocks, seed)))
    return z.drop(*zc), how


def row_blocks(df: DataFrame, key: str, n_blocks: int = N_BLOCKS) -> DataFrame:
    return df.withColumn("block", F.pmod(F.col(key), F.lit(n_blocks)).cast("int"))


def group_folds(sizes: dict, n_folds: int = N_FOLDS) -> dict:
    """Blocks, largest first, each to the fold that is lightest so far."""
    n_folds = min(n_folds, len(sizes))
    load = [0] * n_folds
    out = {}
    for block, n in sorted(sizes.items(), key=lambda kv: (-kv[1], -kv[0])):
        i = load.index(min(load))
        out[block] = i
        load[i] += n
    return out


def assign_folds(df: DataFrame, key: str, n_folds: int = N_FOLDS) -> DataFrame:
    """Add ``fold`` so that no block is split; random folds if there is one block."""
    sizes = {r["block"]: r["count"] for r in df.groupBy("block").count().collect()}
    if min(n_folds, len(sizes)) < 2:
        return random_folds(df, key, N_FOLDS)
    folds = group_folds(sizes, n_folds)
    lookup = F.create_map(*[F.lit(x) for kv in sorted(folds.items()) for x in kv])
    return df.withColumn("fold", F.element_at(lookup, F.col("block")))


def random_folds(df: DataFrame, key: str, n_folds: int = N_FOLDS, seed: int = 0, out: str = "fold") -> DataFrame:
    return df.withColumn(out, hash_bucket(key, n_folds, seed))


def morans_i(df: DataFrame, value: str, lon: str, lat: str, key: str, k: int = MORAN_NEIGHBOURS,
             sample: int | None = None, **kw) -> DataFrame:
    """One row ``n, k, morans_i`` with binary k-nearest weights, self excluded.

    ``sample`` bounds the rows used; by default all are.
    """
    d = df.select(key, lon, lat, value).dropna()
    if sample is not None:
        d = hash_sample(d, key, sample)
    s = d.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).first()
    n = s["n"]
    kk = min(k, max(n - 1, 0))
    base = d.sparkSession
    if n < MORAN_MIN_ROWS or not s["v"]:
        return base.createDataFrame([(n, kk, None)], "n bigint, k int, morans_i double")
    z = d.select(key, lon, lat, (F.col(value) - F.lit(s["m"])).alias("z"))
    near = knn_mean(z, z, [lon, lat], kk, key, value="z", exclude_self=True, own="z", **kw)
    return near.agg(F.lit(n).cast("bigint").alias("n"), F.lit(kk).alias("k"),
                    (F.sum(F.col("own") * F.col("mean") * F.col("near")) / F.lit(float(kk)) / F.sum(F.col("own") * F.col("own"))).alias("morans_i"))


def residual_verdict(moran: Column) -> Column:
    return F.when(moran > RESIDUAL_LIMIT, LEAKS).otherwise(CLEAN)
