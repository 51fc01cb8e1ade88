"""Variance inflation factors and backward screening of predictors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from heatscape.operators.linear import moments

VIF_LIMIT = 10.0
INFINITE_VIF = 1e6
#: Share of variance below which a column counts as determined by others.
SINGULAR = 1e-12


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """p x p Pearson matrix from one aggregate."""
    m = moments(df, cols)
    sd = np.sqrt(np.diag(m.co))
    sd[sd == 0] = 1.0
    r = m.co / np.outer(sd, sd)
    np.fill_diagonal(r, 1.0)
    return r


def vif_from_correlation(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each column on all others; 1e6 where the others determine it.

    For a regular matrix this is the diagonal of its inverse. A singular one says nothing of the
    columns outside the dependence, so there every column is regressed by itself.
    """
    if np.linalg.cond(r) < 1 / SINGULAR:
        v = np.diag(np.linalg.inv(r)).copy()
    else:
        v = np.empty(len(r))
        for j in range(len(r)):
            rest = np.delete(np.arange(len(r)), j)
            left = 1.0 - r[j, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], rcond=SINGULAR, hermitian=True) @ r[rest, j]
            v[j] = 1.0 / left if left > SINGULAR else np.inf
    v[np.isnan(v)] = 0.0
    return np.where(~np.isfinite(v) | (v < 0), INFINITE_VIF, v)


def vif_table(df: DataFrame, cols: list[str]) -> DataFrame:
    v = vif_from_correlation(correlation_matrix(df, cols))
    return df.sparkSession.createDataFrame(
        [(c, float(x)) for c, x in zip(cols, v)], "feature string, vif double")


def screen(r: np.ndarray, cols: list[str], limit: float = VIF_LIMIT) -> tuple[list[str], list[tuple]]:
    """Drop the worst predictor until all are below ``limit`` or two are left."""
    keep = list(range(len(cols)))
    history: list[tuple] = []
    while len(keep) > 2:
        v = vif_from_correlation(r[np.ix_(keep, keep)])
        worst = int(np.argmax(v))
        if v[worst] <= limit:
            ordered = [worst, *[i for i in range(len(keep)) if i != worst]]
            history += [(cols[keep[i]], float(v[i]), "retained") for i in ordered]
            break
        history.append((cols[keep[worst]], float(v[worst]), "removed"))
        del keep[worst]
    return [cols[i] for i in keep], history


def vif_screen(df: DataFrame, cols: list[str], limit: float = VIF_LIMIT) -> tuple[list[str], DataFrame]:
    """Retained predictors and the history ``feature, vif, action``; one pass over the rows."""
    kept, history = screen(correlation_matrix(df, cols), cols, limit)
    return kept, df.sparkSession.createDataFrame(history, "feature string, vif double, action string")
