"""Climate clusters found in the data, their profile and their signature."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.functions.columns import add, split_hash
from heatscape.operators.clean import standardise
from heatscape.operators.spatial import fit_centres, nearest_centre
from heatscape.session import side_by_side

K_RANGE = range(3, 9)
#: Rows whose plain silhouettes are taken, and distances held at once.
QUERIES, CELLS = 5000, 2_000_000


def silhouette(df: DataFrame, cols: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette of squared distances, over all rows and without pairs.

    The mean squared distance of a row to a cluster follows from the cluster's
    size, mean vector and mean squared norm, so k x (p + 2) numbers suffice.
    """
    norm = add([F.col(f"`{c}`") * F.col(f"`{c}`") for c in cols])
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("sq"),
                                    *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]).collect()

    def mean_distance(s) -> Column:
        return norm + F.lit(s["sq"]) - add([F.col(f"`{c}`") * F.lit(2.0 * s[f"m{i}"]) for i, c in enumerate(cols)])

    own = other = size = None
    for s in stats:
        mine = F.col(cluster) == s[cluster]
        inside = mean_distance(s) * F.lit(float(s["n"]) / max(s["n"] - 1, 1))
        own = F.when(mine, inside) if own is None else own.when(mine, inside)
        size = F.when(mine, F.lit(s["n"])) if size is None else size.when(mine, F.lit(s["n"]))
        away = F.when(~mine, mean_distance(s))
        other = away if other is None else F.least(other, away)
    d = df.select(own.alias("a"), other.alias("b"), size.alias("n"))
    one = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return d.agg(F.avg(one).alias("silhouette"))


def plain_silhouettes(df: DataFrame, cols: list[str], key: str, clusters: list[str], queries: int = QUERIES) -> dict[str, float]:
    """Mean silhouette of plain distances for each of several columns of cluster numbers, in one pass over the distances.

    ``queries`` rows, by hash order of the key, meet all rows: exact for tables of no more rows, else the mean over a
    sample of rows whose own silhouettes are exact.  Every task adds up its distances by query and cluster first.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     *[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(clusters)])
    taken = rows.orderBy(split_hash("k"), "k").limit(queries).toPandas()
    xs, cs = [f"x{i}" for i in range(len(cols))], [f"c{i}" for i in range(len(clusters))]
    counts = [{r[0]: r[1] for r in rows.groupBy(c).count().collect()} for c in cs]
    places = [{v: i for i, v in enumerate(sorted(n))} for n in counts]
    given = spark.sparkContext.broadcast((taken[xs].to_numpy(float), places))

    def run(batches):
        q, known = given.value
        sums = [np.zeros((len(q), len(p))) for p in known]
        for pdf in batches:
            x = pdf[xs].to_numpy(float)
            step = max(1, CELLS // max(1, len(q)))
            for a in range(0, len(x), step):
                part = x[a:a + step]
                d = np.sqrt(sum((q[:, j][:, None] - part[:, j][None, :]) ** 2 for j in range(q.shape[1])))
                for total, p, c in zip(sums, known, cs):
                    member = np.zeros((len(part), len(p)))
                    member[np.arange(len(part)), pdf[c].iloc[a:a + step].map(p).to_numpy()] = 1.0
                    total += d @ member
        for i, total in enumerate(sums):
            yield pd.DataFrame({"i": i, "q": np.repeat(np.arange(len(q)), total.shape[1]), "c": np.tile(np.arange(total.shape[1]), len(q)), "s": total.ravel()})

    found = rows.mapInPandas(run, "i int, q int, c int, s double").groupBy("i", "q", "c").agg(F.sum("s").alias("s")).toPandas()
    out = {}
    for i, name in enumerate(clusters):
        own = found[found["i"] == i]
        sums = np.zeros((len(taken), len(places[i])))
        sums[own["q"], own["c"]] = own["s"]
        n = np.array([counts[i][v] for v in sorted(counts[i])], float)
        mine = taken[cs[i]].map(places[i]).to_numpy()
        at = np.arange(len(taken))
        inside = sums[at, mine] / np.maximum(n[mine] - 1, 1)
        mean = sums / n
        mean[at, mine] = np.inf
        away = mean.min(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            one = np.where((n[mine] > 1) & np.isfinite(away) & (np.maximum(inside, away) > 0), (away - inside) / np.maximum(inside, away), 0.0)
        out[name] = float(one.mean()) if len(one) else 0.0
    return out


def cluster_rows(df: DataFrame, features: list[str], k: int, seed: int = 42) -> DataFrame:
    """Add ``cluster`` from k-means on standardised features of all rows."""
    z = standardise(df, features)
    zs = [f"z_{c}" for c in features]
    return z.withColumn("cluster", nearest_centre(zs, fit_centres(z, zs, k, seed))).drop(*zs)


def choose_k(df: DataFrame, features: list[str], ks=K_RANGE, seed: int = 42, key: str | None = None) -> tuple[int, dict]:
    """k of highest silhouette, with all scores.

    With ``key`` distances are plain ones, else squared ones, which may choose another k.
    """
    z = standardise(df, features).select(*([key] if key else []), *[f"z_{c}" for c in features]).persist()
    zs = [f"z_{c}" for c in features]
    centres = dict(zip(ks, side_by_side(df.sparkSession, [partial(fit_centres, z, zs, k, seed) for k in ks])))
    if key:
        labelled = z.withColumns({f"of_{k}": nearest_centre(zs, c) for k, c in centres.items()})
        found = plain_silhouettes(labelled, zs, key, [f"of_{k}" for k in ks])
        scores = {k: found[f"of_{k}"] for k in ks}
    else:
        scores = {k: silhouette(z.withColumn("cluster", nearest_centre(zs, c)), zs).first()["silhouette"] for k, c in centres.items()}
    z.unpersist()
    return max(scores, key=lambda k: scores[k]), scores


def cluster_profile(df: DataFrame, features: list[str], lst: str, cluster: str = "cluster",
                    by: list[str] = ()) -> DataFrame:
    """Feature means, size, share of rows and mean target per cluster."""
    by = list(by)
    d = df.groupBy(*by, cluster).agg(*[F.avg(f"`{c}`").alias(c) for c in features],
                                     F.avg(f"`{lst}`").alias("Mean_LST_C"), F.count(F.lit(1)).alias("N_pixels"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # one row per cluster by now
    return d.withColumn("Pct_area", 100.0 * F.col("N_pixels") / F.sum("N_pixels").over(whole))


def signatures(profile: DataFrame, features: list[str], cluster: str = "cluster", by: list[str] = (),
               top: int = 2) -> DataFrame:
    """Add ``Signature``: the features in which a cluster differs most from the others."""
    by = list(by)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("f"), F.col(f"`{f}`").alias("v"))
                                for i, f in enumerate(features)]))
    long = profile.select(*by, cluster, cells.alias("c")).select(*by, cluster, "c.*")
    across = W.partitionBy(*by, "f")
    z = (F.col("v") - F.avg("v").over(across)) / (F.stddev_samp("v").over(across) + 1e-12)
    best = W.partitionBy(*by, cluster).orderBy(F.desc(F.abs("z")), "i")
    text = F.concat(F.when(F.col("z") > 0, "high ").otherwise("low "), F.col("f"))
    named = (long.withColumn("z", z).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top)
             .groupBy(*by, cluster).agg(F.array_join(F.transform(
                 F.sort_array(F.collect_list(F.struct("r", text.alias("t")))), lambda s: s["t"]), " / ")
                 .alias("Signature")))
    return profile.join(named, [*by, cluster])


def discover(df: DataFrame, features: list[str], lst: str, ks=K_RANGE, seed: int = 42, key: str | None = None):
    """Profile hottest first, labelled rows and the scores per k."""
    k, scores = choose_k(df, features, ks, seed, key)
    rows = cluster_rows(df, features, k, seed)
    table = signatures(cluster_profile(rows, features, lst), features).orderBy(F.desc("Mean_LST_C"))
    return table, rows, {"chosen_k": k, "silhouette": scores[k], "all_scores": scores}


def min_max(profile: DataFrame, value: str, out: str, by: list[str] = ()) -> DataFrame:
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return profile.withColumn(out, F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0))
