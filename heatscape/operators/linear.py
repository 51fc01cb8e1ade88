"""Least squares and ridge regression from one aggregate over the rows.

The rows are reduced to counts, means and comoments (p(p+1)/2 numbers per
group); the driver only solves p x p systems.  Moments of groups merge, so the
training moments of every fold come from one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.functions.columns import add

# The ridge penalties tried.
RIDGE_ALPHAS = [float(a) for a in np.logspace(-3, 3, 25)]
STACK_ALPHAS = [float(a) for a in np.logspace(-3, 3, 15)]


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    co: np.ndarray  # sum of centred products

    def __add__(self, other: "Moments") -> "Moments":
        if self.n == 0 or other.n == 0:
            return other if self.n == 0 else self
        n = self.n + other.n
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n),
                       self.co + other.co + np.outer(d, d) * (self.n * other.n / n))


def _moment_columns(cols: list[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n"), *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(cols)]]
    for i, a in enumerate(cols):
        out += [F.covar_pop(f"`{a}`", f"`{b}`").alias(f"c{i}_{j}") for j, b in enumerate(cols) if j >= i]
    return out


def _moments(row, p: int) -> Moments:
    n = row["n"]
    co = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            co[i, j] = co[j, i] = (row[f"c{i}_{j}"] or 0.0) * n
    return Moments(n, np.array([row[f"m{i}"] or 0.0 for i in range(p)]), co)


def moments(df: DataFrame, cols: list[str]) -> Moments:
    d = df.select(*[f"`{c}`" for c in cols]).dropna()
    return _moments(d.agg(*_moment_columns(cols)).first(), len(cols))


def moments_by(df: DataFrame, cols: list[str], key: str) -> dict:
    """Moments per group, for a key with few values such as a fold."""
    d = df.select(key, *[f"`{c}`" for c in cols]).dropna()
    return {r[key]: _moments(r, len(cols)) for r in d.groupBy(key).agg(*_moment_columns(cols)).collect()}


def without(groups: dict, key) -> Moments:
    total = None
    for k, m in sorted(groups.items()):
        if k != key:
            total = m if total is None else total + m
    return total


@dataclass
class LinearModel:
    """Intercept and slopes on the original scale."""

    features: list
    intercept: float
    coef: np.ndarray
    means: np.ndarray
    scales: np.ndarray
    alpha: float = 0.0
    se: np.ndarray | None = None  # of the standardised slopes
    rss: float = 0.0
    n: int = 0

    @property
    def z_coef(self) -> np.ndarray:
        return self.coef * self.scales

    def column(self) -> Column:
        return add([F.lit(float(self.intercept)),
                    *[F.col(f"`{f}`") * F.lit(float(b)) for f, b in zip(self.features, self.coef)]])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.column())


def solve(m: Moments, features: list[str], alpha: float = 0.0) -> LinearModel:
    """Fit on standardised features (population deviation), penalty ``alpha``."""
    p = len(features)
    sd = np.sqrt(np.maximum(np.diag(m.co)[:p] / m.n, 0.0))
    sd[sd == 0] = 1.0
    zz = m.co[:p, :p] / np.outer(sd, sd)
    zy = m.co[:p, p] / sd
    a = zz + alpha * np.eye(p)
    inv = np.linalg.pinv(a, hermitian=True)
    b = inv @ zy
    rss = float(m.co[p, p] - 2 * b @ zy + b @ zz @ b)
    dof = max(1, m.n - p - 1)
    se = np.sqrt(np.maximum(np.diag(inv) * max(rss, 0.0) / dof, 0.0))
    coef = b / sd
    return LinearModel(list(features), float(m.mean[p] - coef @ m.mean[:p]), coef, m.mean[:p].copy(), sd,
                       alpha, se, max(rss, 0.0), m.n)


def fit_ols(df: DataFrame, features: list[str], y: str) -> LinearModel:
    return solve(moments(df, [*features, y]), features)


def loo_errors(df: DataFrame, features: list[str], y: str, m: Moments,
               alphas: list[float] = RIDGE_ALPHAS) -> list[float]:
    """Exact leave-one-out mean squared error per penalty, in one pass.

    In the eigenbasis of the standardised Gram matrix every penalty has a
    diagonal solve, so a row's residual and leverage are short sums.
    """
    p = len(features)
    sd = np.sqrt(np.maximum(np.diag(m.co)[:p] / m.n, 0.0))
    sd[sd == 0] = 1.0
    lam, vec = np.linalg.eigh(m.co[:p, :p] / np.outer(sd, sd))
    g = vec.T @ (m.co[:p, p] / sd)
    z = [(F.col(f"`{f}`") - F.lit(float(m.mean[i]))) / F.lit(float(sd[i])) for i, f in enumerate(features)]
    d = df.select(*[f"`{c}`" for c in (*features, y)]).dropna()
    d = d.select((F.col(f"`{y}`") - F.lit(float(m.mean[p]))).alias("yc"),
                 *[add([z[i] * F.lit(float(vec[i, j])) for i in range(p)]).alias(f"u{j}") for j in range(p)])
    # one small expression over (row, penalty) instead of one large one per penalty
    shrink = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[
        F.lit(1.0 / max(float(lam[j]) + alpha, 1e-12)).alias(f"s{j}") for j in range(p)])
        for i, alpha in enumerate(alphas)]))
    d = d.select("yc", *[f"u{j}" for j in range(p)], shrink.alias("a"))
    u = [F.col(f"u{j}") * F.col(f"a.s{j}") for j in range(p)]
    fit = add([u[j] * F.lit(float(g[j])) for j in range(p)])
    leverage = add([F.lit(1.0 / m.n), *[u[j] * F.col(f"u{j}") for j in range(p)]])
    e = (F.col("yc") - fit) / (1.0 - leverage)
    found = {r["i"]: r["mse"] for r in d.groupBy("a.i").agg(F.avg(e * e).alias("mse")).collect()}
    return [found[i] for i in range(len(alphas))]


def fit_ridge(df: DataFrame, features: list[str], y: str, alphas: list[float] = RIDGE_ALPHAS) -> LinearModel:
    """Ridge with the penalty of least leave-one-out error."""
    m = moments(df, [*features, y])
    errors = loo_errors(df, features, y, m, alphas)
    return solve(m, features, alphas[int(np.argmin(errors))])


def ols_by_fold(df: DataFrame, features: list[str], y: str, fold: str = "fold") -> dict:
    """One model per fold, trained on all other folds, from a single pass."""
    groups = moments_by(df, [*features, y], fold)
    return {k: solve(without(groups, k), features) for k in groups}


def predict_by_fold(df: DataFrame, models: dict, fold: str = "fold") -> DataFrame:
    """Each row is predicted by the model that did not see its fold."""
    c = None
    for k, m in sorted(models.items()):
        c = F.when(F.col(fold) == k, m.column()) if c is None else c.when(F.col(fold) == k, m.column())
    return df.withColumn("prediction", c)
