"""Small Column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

HASH_RANGE = 2147483648


def split_hash(key: Column | str, seed: int = 0) -> Column:
    """Integer hash in [0, 2**31) of a numeric key, the same on every run.

    Take the high part for splits: the low bits only repeat those of the key.
    """
    k = F.col(key) if isinstance(key, str) else key
    base = F.pmod(k.cast("bigint"), F.lit(HASH_RANGE).cast("bigint"))
    return F.pmod(base * F.lit(1103515245).cast("bigint") + F.lit(12345 + seed).cast("bigint"),
                  F.lit(HASH_RANGE).cast("bigint"))


def hash_bucket(key: Column | str, n: int, seed: int = 0) -> Column:
    """Balanced bucket number 0..n-1 from the high part of the hash."""
    return F.floor(split_hash(key, seed) * F.lit(n).cast("bigint") / F.lit(HASH_RANGE)).cast("int")


def unit_hash(key: Column | str, seed: int = 0) -> Column:
    return split_hash(key, seed).cast("double") / F.lit(float(HASH_RANGE))


def add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    return add([(x - y) * (x - y) for x, y in zip(a, b)])


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric value of any column; unreadable text and NaN become NULL.

    Text is matched before it is cast: a failed cast costs an exception per row.
    """
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, StringType):
        return F.when(c.rlike(NUMBER), c.try_cast("double"))
    if not isinstance(df.schema[name].dataType, (NumericType, BooleanType)):  # dates, times, bytes, nested values
        return F.lit(None).cast("double")
    return null_if_nan(c.try_cast("double"))


# Coefficients of the Chebyshev fit to erfc (relative error below 1.2e-7).
ERFC_FIT = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
            0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc_nonnegative(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = 1.0 / (1.0 + x * 0.5)
    poly = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(poly - x * x)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a z statistic."""
    return F.least(erfc_nonnegative(F.abs(z) / F.sqrt(F.lit(2.0))), F.lit(1.0))


def r2(y: str, p: str) -> Column:
    """1 - SSE/SST as one aggregate; variance is the mergeable stable form."""
    sse = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1.0 - sse / sst)
