"""Union of cleaned zones on one vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.operators.clean import Cleaned
from heatscape.operators.roles import RoleMap


def canonical_frame(frame: DataFrame, roles: RoleMap, zone: str, with_coordinates: bool) -> DataFrame:
    """Indices, target and coordinates under their canonical names."""
    names = {v: k for k, v in roles.indices.items()}
    names[roles.lst] = "LST"
    if with_coordinates:
        names[roles.lat], names[roles.lon] = "LAT", "LON"
    return frame.withColumnsRenamed(names).withColumns(
        {"_is_north": F.lit(1 if "North" in zone else 0), "zone_label": F.lit(zone)})


def pool(zones: list[tuple[str, Cleaned]], keep: tuple = ()) -> tuple[DataFrame, RoleMap]:
    """Pooled frame ``LST, [LAT, LON], shared predictors, _is_north, zone_label``.

    Coordinates stay only if every zone has both; they define blocks and are
    never predictors.
    """
    with_xy = all(c.roles.lat and c.roles.lon for _, c in zones)
    parts = [canonical_frame(c.frame, c.roles, z, with_xy) for z, c in zones]
    shared = set.intersection(*[
        {*c.roles.indices, *[e for e in c.roles.extras if e not in c.roles.target_like]} for _, c in zones])
    feats = sorted(shared - {"LAT", "LON"})
    cols = [*keep, "LST", *(["LAT", "LON"] if with_xy else []), *feats, "_is_north", "zone_label"]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    roles = RoleMap(table="pooled", lst="LST", lat="LAT" if with_xy else None, lon="LON" if with_xy else None,
                    indices={c: c for c in feats}, extras=("_is_north",))
    return out, roles
