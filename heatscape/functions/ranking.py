"""Exact ranks and quantiles of tables of any size.

A global window sends all rows to one task and the exact ``percentile``
aggregate holds every distinct value in one buffer, so both are kept for small
inputs only.  Ranks of large tables come from a range shuffle: Spark sorts the
rows into consecutive partitions, and a row's place is its place inside the
partition plus the sizes of the partitions before it.  Quantiles of large
tables need no sort: counts per bin show which bin holds the wanted place, and
the next pass looks into that bin only.  Many quantiles at a time are read off the
ranks, since together the bins that hold them have most of the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from heatscape.session import materialise

# The percentile aggregate keeps about 100 bytes per distinct value of a group.
SMALL_ROWS = 1_000_000
# Bins per pass and the number of values that are fetched as they are.
BINS = 1024
FEW_VALUES = 2000
MAX_GROUPS = 1000
# Places beyond which the last pass could fetch much of the table, so that ranks are cheaper.
MOST_PLACES = 100


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list[str], keys: list[str] = (), out: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row by ``order`` within ``keys``.

    ``order`` should end in a unique column.  No group is brought together in
    one task, so one key may hold most of the rows.
    """
    keys = list(keys)
    cols = [*keys, *order]
    placed = materialise(
        df.repartitionByRange(shuffle_width(df), *cols)
        .sortWithinPartitions(*cols)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    part = F.shiftright("__place", 33)
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per (partition, key): the key starts once, every partition adds few.
    sizes = placed.groupBy(part.alias("__part"), *keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min(inside).alias("__first"))
    if keys:
        w = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    else:
        w = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__part", *keys, "__first",
                           F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    left = placed.withColumn("__part", part).withColumn("__inside", inside)
    on = F.col("l.__part") == F.col("o.__part")
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    return left.alias("l").join(offsets.alias("o"), on).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("o.__before") + F.col("l.__inside") - F.col("o.__first")).alias(out))


def _at(level: float, n: int) -> tuple[int, int, float]:
    """Lower place, upper place and weight of the upper one."""
    spot = (n - 1) * level
    low = int(np.floor(spot))
    return low, min(low + 1, n - 1), spot - low


def _between(a: float, b: float, w: float) -> float:
    """The value at weight ``w`` from ``a`` to ``b``, either of which may be infinite."""
    if a == b or w == 0:
        return a
    return a + (b - a) * w if np.isfinite(a) and np.isfinite(b) else a * (1 - w) + b * w


def _infinite_ends(df: DataFrame, key: str, value: str) -> dict:
    """Group -> (values at minus infinity, at infinity, least and greatest finite value)."""
    v = F.col(value)
    finite = F.when(F.abs(v) < float("inf"), v)
    rows = df.groupBy(key).agg(F.count_if(v == float("-inf")), F.count_if(v == float("inf")), F.min(finite), F.max(finite))
    return {r[0]: tuple(r)[1:] for r in rows.collect()}


def values_at(df: DataFrame, key: str, value: str, places: dict[object, list[int]], stats: dict) -> dict:
    """Values at 0-based places in each group's order, by narrowing intervals.

    ``stats`` maps a group to its (count, minimum, maximum).  Every pass counts
    rows per bin of the intervals still open; a pass returns at most ``BINS``
    rows per interval and the last one at most ``FEW_VALUES``.
    """
    spark = df.sparkSession
    out: dict = {}
    # an interval: group, lowest and highest value, rows below it, rows in it, wanted places
    todo = []
    ends = _infinite_ends(df, key, value) if any(np.isinf([x for _, *x in stats.values()]).ravel()) else {}
    for g, (n, lo, hi) in stats.items():
        low, high, first, last = ends.get(g, (0, 0, lo, hi))
        for p in places.get(g) or []:  # an infinite value is its own interval
            if p < low or p >= n - high:
                out[g, p] = -np.inf if p < low else np.inf
        want = sorted({p for p in places.get(g) or [] if low <= p < n - high})
        if want:
            todo.append((g, first, last, low, n - low - high, want))
    schema = StructType([StructField("__i", IntegerType()), StructField("__g", df.schema[key].dataType),
                         StructField("__lo", DoubleType()), StructField("__hi", DoubleType())])

    def inside(intervals):
        rows = [(i, g, lo, hi) for i, (g, lo, hi, *_) in enumerate(intervals)]
        at = (F.col(key).eqNullSafe(F.col("__g"))) & F.col(value).between(F.col("__lo"), F.col("__hi"))
        return df.join(F.broadcast(spark.createDataFrame(rows, schema)), at)

    while todo:
        for g, lo, hi, _, _, want in todo:
            if lo == hi:
                out.update({(g, p): lo for p in want})
        todo = [t for t in todo if t[1] != t[2]]
        few = [t for t in todo if t[4] <= FEW_VALUES]
        todo = [t for t in todo if t[4] > FEW_VALUES]
        if few:
            found: dict[int, list[float]] = {}
            for r in inside(few).select("__i", F.col(value).alias("v")).collect():
                found.setdefault(r["__i"], []).append(r["v"])
            for i, (g, _, _, below, _, want) in enumerate(few):
                v = sorted(found[i])
                out.update({(g, p): v[p - below] for p in want})
        if not todo:
            break
        wide = F.col("__hi") - F.col("__lo")
        # halves of values whose distance is beyond the largest double
        share = F.when(wide < float("inf"), (F.col(value) - F.col("__lo")) / wide).otherwise(
            (F.col(value) / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2))
        counted = inside(todo).groupBy("__i", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        bins: dict[int, list] = {}
        for r in counted:
            bins.setdefault(r["__i"], []).append((r["lo"], r["hi"], r["n"]))
        narrowed = []
        for i, (g, _, _, below, _, want) in enumerate(todo):
            for lo, hi, n in sorted(bins[i]):
                here = [p for p in want if below <= p < below + n]
                if here:
                    narrowed.append((g, lo, hi, below, n, here))
                below += n
        todo = narrowed
    return out


def _ranked_values(df: DataFrame, key: str, value: str, places: dict[object, list[int]], stats: dict) -> dict:
    """As ``values_at``, from the ranks of all rows; the wanted ones only are fetched."""
    # a number for each row, so that equal values can be in several tasks
    ranked = global_rank(df.withColumn("__tie", F.monotonically_increasing_id()), [value, "__tie"], [key], "__rank")
    schema = StructType([StructField("__g", df.schema[key].dataType), StructField("__p", LongType())])
    wanted = df.sparkSession.createDataFrame([(g, p) for g, ps in places.items() for p in sorted(set(ps))], schema)
    at = F.col(key).eqNullSafe(F.col("__g")) & (F.col("__rank") == F.col("__p"))
    return {(g, p): v for g, p, v in ranked.join(F.broadcast(wanted), at).select("__g", "__p", value).collect()}


def quantiles(df: DataFrame, value: str, levels: list[float], keys: list[str] = (),
              small_rows: int = SMALL_ROWS, max_groups: int = MAX_GROUPS, rows: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: ``keys``, ``n`` and array ``q``.

    Small inputs take the built-in aggregate, few groups of any size take bin
    counts, and many groups take sorted ranks.  Nulls and NaN are left out,
    infinities are values like others.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    if (d.count() if rows is None else rows) <= small_rows:
        return d.groupBy(*keys).agg(
            F.count(value).alias("n"),
            F.expr(f"percentile(`{value}`, array({', '.join(f'{x!r}D' for x in levels)}))").alias("q"))
    one = F.struct(*keys) if keys else F.lit(0)
    sizes = d.groupBy(one.alias("__key")).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    groups = sizes.limit(max_groups + 1).collect()
    if len(groups) > max_groups:
        return _sorted_quantiles(d, value, levels, keys)
    stats = {r["__key"]: (r["n"], r["lo"], r["hi"]) for r in groups}
    places = {g: [p for x in levels for p in _at(x, n)[:2]] for g, (n, _, _) in stats.items()}
    find = _ranked_values if sum(map(len, places.values())) > MOST_PLACES else values_at
    got = find(d.select(one.alias("__key"), value), "__key", value, places, stats)
    out = []
    for g, (n, _, _) in stats.items():
        spots = [_at(x, n) for x in levels]
        out.append((*(g if keys else ()), n, [_between(got[g, a], got[g, b], w) for a, b, w in spots]))
    schema = StructType([*[d.schema[k] for k in keys], StructField("n", LongType()),
                         StructField("q", ArrayType(DoubleType()))])
    return df.sparkSession.createDataFrame(out, schema)


def _sorted_quantiles(d: DataFrame, value: str, levels: list[float], keys: list[str]) -> DataFrame:
    # a number for each row, so that equal values can be in several tasks
    ranked = global_rank(d.withColumn("__tie", F.monotonically_increasing_id()), [value, "__tie"], keys, "__rank")
    r = ranked.join(d.groupBy(*keys).agg(F.count(value).alias("n")), keys)
    spots = []
    for i, level in enumerate(levels):
        at = (F.col("n") - 1) * F.lit(float(level))
        low = F.floor(at)
        weight = (F.when(F.col("__rank") == low, 1.0 - (at - low)).otherwise(0.0)
                  + F.when(F.col("__rank") == low + 1, at - low).otherwise(0.0))
        spots.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(f"__q{i}"))
    return r.groupBy(*keys).agg(F.max("n").alias("n"), *spots).select(
        *keys, "n", F.array(*[f"__q{i}" for i in range(len(levels))]).alias("q"))


def quantile_values(df: DataFrame, value: str, levels: list[float], **kw) -> list[float]:
    row = quantiles(df, value, levels, **kw).first()
    return list(row["q"]) if row and row["q"] is not None else [None] * len(levels)


def column_quantiles(df: DataFrame, levels: dict[str, list[float]], **kw) -> dict[str, list[float]]:
    """Quantiles of several numeric columns in one job; nulls are left out."""
    cols = [c for c in levels if levels[c]]
    if not cols:
        return {}
    want = sorted({x for c in cols for x in levels[c]})
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)]))
    long = df.select(pairs.alias("p")).select("p.i", "p.v")
    got = {r["i"]: r["q"] for r in quantiles(long, "v", want, ["i"], **kw).collect()}
    return {c: [got[i][want.index(x)] if i in got else None for x in levels[c]] for i, c in enumerate(cols)}
