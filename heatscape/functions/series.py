"""Pair statistics of one short time series held in an array column.

A series has one value per distinct year, so an array of it is small.  Pairs
are visited inside the row and never become rows.  Series of more than
``PAIRWISE_LIMIT`` steps take the n log n form below instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRWISE_LIMIT = 1024


def kendall_s(v: Column) -> Column:
    """Sum of sign(later - earlier) over all pairs."""
    n = F.size(v)
    return F.aggregate(
        F.sequence(F.lit(1), n - 1), F.lit(0.0),
        lambda acc, i: acc + F.aggregate(
            F.slice(v, i + 1, n), F.lit(0.0),
            lambda a, x: a + F.signum(x - F.element_at(v, i.cast("int")))))


def tie_term(v: Column) -> Column:
    """Sum of t(t-1)(2t+5) over groups of equal values."""
    def one(a, u):
        t = F.size(F.filter(v, lambda x: x == u)).cast("double")
        return a + t * (t - 1.0) * (2.0 * t + 5.0)
    return F.aggregate(F.array_distinct(v), F.lit(0.0), one)


def array_median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    low = F.floor((n - 1) / 2).cast("int") + 1
    high = F.floor(n / 2).cast("int") + 1
    return (F.element_at(s, low) + F.element_at(s, high)) / 2.0


def sen_slope(v: Column) -> Column:
    """Median slope over all pairs, in steps of the series."""
    n = F.size(v)
    slopes = F.flatten(F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.transform(F.slice(v, i + 1, n),
                              lambda x, j: (x - F.element_at(v, i.cast("int"))) / (j + 1))))
    return array_median(slopes)


def falling_pairs(a: np.ndarray) -> int:
    """Number of pairs i < j with a[j] <= a[i]."""
    total, blocks = 0, []
    for s in range(0, len(a), 128):
        b = a[s:s + 128]
        total += int(np.triu(b[None, :] <= b[:, None], 1).sum())
        blocks.append(np.sort(b))
    while len(blocks) > 1:
        merged = []
        for left, right in zip(blocks[::2], blocks[1::2]):
            total += int((len(left) - np.searchsorted(left, right, side="left")).sum())
            merged.append(np.sort(np.concatenate([left, right]), kind="stable"))
        if len(blocks) % 2:
            merged.append(blocks[-1])
        blocks = merged
    return total


def _slope_at(v: np.ndarray, place: int) -> float:
    """Slope with the given place (1-based) in the sorted list of all pair slopes."""
    steps = np.arange(len(v), dtype=float)
    spread = float(v.max() - v.min())
    lo, hi = -spread - 1.0, spread + 1.0
    while True:
        mid = (lo + hi) / 2.0
        if mid <= lo or mid >= hi:
            return hi
        # slope <= mid exactly when v - mid*step does not rise over the pair
        if falling_pairs(v - mid * steps) >= place:
            hi = mid
        else:
            lo = mid


STATISTICS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("s", "ties", "slope")])


@F.pandas_udf(STATISTICS)
def long_series(series: pd.Series) -> pd.DataFrame:
    rows = []
    for raw in series:
        v = np.asarray(raw, dtype=float)
        n = len(v)
        _, t = np.unique(v, return_counts=True)
        t = t.astype(float)
        pairs = n * (n - 1) // 2
        s = falling_pairs(-v) - falling_pairs(v)
        slope = (_slope_at(v, (pairs + 1) // 2) + _slope_at(v, pairs // 2 + 1)) / 2.0
        rows.append((float(s), float((t * (t - 1) * (2 * t + 5)).sum()), slope))
    return pd.DataFrame(rows, columns=["s", "ties", "slope"])
