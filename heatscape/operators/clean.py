"""Cleaning of an observation table: units, gaps, outliers, dead columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.functions.columns import as_double, split_hash
from heatscape.functions.naming import UNSCALED
from heatscape.functions.ranking import column_quantiles
from heatscape.operators.roles import RoleMap

# Fixed values of the cleaning rules.
KELVIN_MEDIAN = 200.0
KELVIN_OFFSET = 273.15
RESCALE_ABOVE = 10.0
MIN_PREDICTOR_VALUES = 20
MIN_PREDICTOR_SHARE = 0.05
WINSOR_LEVELS = (0.002, 0.998)
WINSOR_MIN_ROWS = 100


@dataclass(frozen=True)
class Cleaned:
    frame: DataFrame
    roles: RoleMap
    report: DataFrame


def coerce(df: DataFrame, roles: RoleMap, keep: tuple = ()) -> DataFrame:
    """Project to the columns in use; all but the zone become doubles."""
    named = [c for c in (roles.lst, roles.lat, roles.lon, roles.year, roles.zone) if c]
    cols = list(dict.fromkeys([*named, *roles.features()]))
    return df.select(*[F.col(f"`{c}`") for c in keep if c not in cols],
                     *[F.col(f"`{c}`").cast("string").alias(c) if c == roles.zone else as_double(df, c).alias(c)
                       for c in cols])


def rescale_factor(max_abs: float | None) -> float:
    """Power of ten that brings integer-stored indices into [-1, 1]."""
    if max_abs is None or max_abs <= RESCALE_ABOVE:
        return 1.0
    return float(10 ** math.ceil(math.log10(max_abs)))


def clean(df: DataFrame, roles: RoleMap, keep: tuple = ()) -> Cleaned:
    """Cleaned frame, reduced role map and one-row report.

    Two passes over the table: counts and ranges, then all quantiles at once.
    Medians and winsor bounds are taken on stored values and converted, because
    unit changes are linear.  ``keep`` names key columns to carry along.
    """
    d = coerce(df, roles, keep)
    feats = roles.features()
    y = F.col(f"`{roles.lst}`")
    present = y.isNotNull()
    aggs = [F.count(F.lit(1)).alias("n0"), F.count_if(present).alias("n")]
    for i, c in enumerate(feats):
        v = F.when(present, F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"c{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    r = d.agg(*aggs).first()
    n = r["n"]
    known = d.where(present)

    scale, rescaled, dead, missing = {}, {}, [], 0
    canonical = {v: k for k, v in roles.indices.items()}
    for i, c in enumerate(feats):
        count, lo, hi = r[f"c{i}"], r[f"lo{i}"], r[f"hi{i}"]
        if c in canonical and canonical[c] not in UNSCALED and count:
            scale[c] = rescale_factor(max(abs(lo), abs(hi)))
            if scale[c] != 1.0:
                rescaled[canonical[c]] = scale[c]
        if count < max(MIN_PREDICTOR_VALUES, MIN_PREDICTOR_SHARE * n) or lo == hi:
            dead.append(c)
        else:
            missing += n - count
    live = roles.without(dead)
    gaps = [c for i, c in enumerate(feats) if c not in dead and r[f"c{i}"] < n]

    levels = {roles.lst: [0.5, *WINSOR_LEVELS], **{c: [0.5] for c in gaps if c != roles.lst}}
    q = column_quantiles(known, levels, rows=n) if n else {}
    mid, lo, hi = q.get(roles.lst) or (None, None, None)
    kelvin = mid is not None and mid > KELVIN_MEDIAN
    shift = KELVIN_OFFSET if kelvin else 0.0
    winsor = n > WINSOR_MIN_ROWS

    target: Column = y - F.lit(shift) if kelvin else y
    outside = F.lit(False)
    if winsor:
        low, high = F.lit(lo - shift), F.lit(hi - shift)
        outside = (target < low) | (target > high)
        target = F.least(F.greatest(target, low), high)

    def predictor(c):
        v = F.col(f"`{c}`")
        if scale.get(c, 1.0) != 1.0:
            v = v / F.lit(scale[c])
        if c in gaps and c in q:
            v = F.coalesce(v, F.lit(q[c][0] / scale.get(c, 1.0)))
        return v.alias(c)

    use = set(live.features())
    frame = known.select(*[target.alias(c) if c == roles.lst else predictor(c) if c in use else F.col(f"`{c}`")
                           for c in known.columns if c not in dead])
    lit_map = (F.create_map(*[F.lit(x) for kv in sorted(rescaled.items()) for x in kv]) if rescaled
               else F.expr("cast(map() as map<string,double>)"))
    report = known.agg(F.count_if(outside).alias("target_winsorised")).select(
        F.lit(roles.table).alias("table"),
        F.lit(r["n0"] - n).cast("bigint").alias("rows_dropped_no_target"),
        F.lit(kelvin).alias("kelvin_to_celsius"), lit_map.alias("rescaled"),
        F.array(*[F.lit(c) for c in dead]).cast("array<string>").alias("dropped_degenerate"),
        "target_winsorised", F.lit(missing).cast("bigint").alias("cells_imputed"),
        F.lit(n).cast("bigint").alias("final_rows"),
        F.lit(len(use)).cast("bigint").alias("final_features"))
    return Cleaned(frame, live, report)


def scaling_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets 1."""
    aggs = [a for i, c in enumerate(cols)
            for a in (F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_pop(f"`{c}`").alias(f"s{i}"))]
    r = df.agg(*aggs).first()
    return {c: (r[f"m{i}"] or 0.0, r[f"s{i}"] or 1.0) for i, c in enumerate(cols)}


def standardise(df: DataFrame, cols: list[str], stats: dict | None = None, prefix: str = "z_") -> DataFrame:
    """Add ``z_<column>`` for every column, with the given or own statistics."""
    stats = stats or scaling_stats(df, cols)
    return df.withColumns({f"{prefix}{c}": (F.col(f"`{c}`") - F.lit(stats[c][0])) / F.lit(stats[c][1]) for c in cols})


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows first in hash order: a repeatable sample without replacement."""
    return df.orderBy(split_hash(key, seed), key).limit(n)


def sizeable_zones(df: DataFrame, zone: str, min_rows: int = 100) -> DataFrame:
    """Rows of zones that hold at least ``min_rows`` rows."""
    big = df.groupBy(zone).count().where(F.col("count") >= min_rows).select(zone)
    return df.join(big, zone, "left_semi")


def has_structure(cleaned: Cleaned, n_rows: int, min_rows: int = 100) -> bool:
    """Enough columns and rows to be modelled."""
    return cleaned.roles.lst is not None and len(cleaned.roles.features()) >= 2 and n_rows >= min_rows
