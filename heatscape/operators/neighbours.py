"""Exact k nearest neighbours as Spark joins.

A reference table of at most ``SMALL_REFERENCE`` rows is broadcast and every
batch of queries meets it in place, without a shuffle.  A larger one is cut
into tiles, with a tree of boxes over them (``tiles.py``).  Queries are cut into
blocks the same way.

1. Each block meets the tile nearest to it; that gives every query a radius
   within which its k neighbours must lie.
2. Each block walks down the tree to the tiles its queries' radii may touch,
   and each query goes to those whose box its own radius touches.
3. The candidates of both steps are merged per query.

A task holds one block and one tile, or one block and the boxes near it.
Nothing that grows with the table is broadcast.  In many dimensions boxes overlap
a lot; tiles then also keep their range of distances from a few pivots, and a
query skips a tile whose range is farther from its own distance than its radius.
A spot shared by many reference rows keeps its k+1 lowest ids, which is all that
any query can use under the (distance, id) order.

``knn`` returns a row for each neighbour, ``knn_mean`` one number for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.functions.columns import squared_distance
from heatscape.functions.ranking import shuffle_width
from heatscape.operators.tiles import FANOUT, SLACK, TILE_ROWS, boxes, first_tiles, tiled, touching, tree
from heatscape.session import materialise

SMALL_REFERENCE = 4096
MAX_TASKS = 20_000
#: Blocks of a task, in few dimensions, where blocks are light beside what a task costs by itself, and in many.
LIGHT_BLOCKS, BLOCKS_PER_TASK = 16, 4
#: Cells of distances that fit a core's cache.
MATRIX_CELLS = 131_072
#: Queries of a group that meets only the rows near it, in at most so many dimensions.
GROUP_ROWS, GROUP_DIMS = 32, 3
#: From this many dimensions on, tiles keep distances from pivots.
PIVOT_DIMS = 4
PIVOTS = 8
FOUND = "ids array<long>, d2 array<double>, vals array<double>"


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):
        diff = q[:, j][:, None] - r[:, j][None, :]
        d += diff * diff
    return d


def meetings(q: np.ndarray, r: np.ndarray, need: int, limit=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, reference rows) that together hold the ``need`` nearest rows of every query.

    In few dimensions queries are halved into small groups.  The distance of the ``need``-th nearest row changes from the
    middle of a group to any of its queries by at most the group's reach, so farther rows are left out on the way.
    """
    every = np.arange(len(r))
    if q.shape[1] > GROUP_DIMS or len(r) <= GROUP_ROWS:
        step = max(1, MATRIX_CELLS // max(1, len(r)))
        for s in range(0, len(q), step):
            yield np.arange(s, min(s + step, len(q))), every
        return
    todo = [(np.arange(len(q)), every)]
    while todo:
        rows, cols = todo.pop()
        own = q[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        at, reach = (low + high) / 2, float(np.sqrt(((high - low) ** 2).sum())) / 2
        if np.isfinite(reach):
            d = np.sqrt(squared_distances(at[None, :], r[cols])[0])
            bound = np.partition(d, need - 1)[need - 1] + 2 * reach if len(cols) >= need else np.inf
            if limit is not None:
                bound = min(bound, float(np.sqrt(limit[rows].max())) + reach)
            cols = cols[d <= bound * SLACK]
        if len(rows) > GROUP_ROWS:
            order = rows[np.argpartition(own[:, int(np.argmax(high - low))], len(rows) // 2)]
            todo += [(order[: len(rows) // 2], cols), (order[len(rows) // 2 :], cols)]
        elif len(cols):
            yield rows, cols


def nearest(q, qid, r, rid, k, exclude_self, limit=None):
    """(query row, reference row, squared distance) of the k nearest by (distance, id)."""
    out = ([], [], [])
    # a query may leave out as many rows as have its id
    need = k + (int(np.unique(rid, return_counts=True)[1].max(initial=0)) if exclude_self else 0)
    for at, among in meetings(q, r, need, limit) if min(k, len(r)) and len(q) else ():
        d = squared_distances(q[at], r[among])
        kk = min(k, len(among))
        if exclude_self:
            d[qid[at][:, None] == rid[among][None, :]] = np.inf
        if limit is not None:
            d[d > limit[at][:, None]] = np.inf
        edge = np.partition(d, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        dist, cols = d[rows, cols], among[cols]
        o = np.lexsort((rid[cols], dist, rows))
        rows, cols, dist = rows[o], cols[o], dist[o]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < k
        for acc, a in zip(out, (at[rows[keep]], cols[keep], dist[keep])):
            acc.append(a)
    if not out[0]:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    rows, cols, dist = (np.concatenate(a) for a in out)
    o = np.argsort(rows, kind="stable")
    return rows[o], cols[o], dist[o]


def columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy() for c in names])


def lists(rows: np.ndarray, n: int, *arrays: np.ndarray) -> list[pa.Array]:
    """Arrow lists, one per query, of arrays sorted by query row."""
    cuts = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
    return [pa.ListArray.from_arrays(cuts, pa.array(a)) for a in arrays]


def points(df: DataFrame, key: str, dims: list[str], value: str | None, key_name: str) -> DataFrame:
    cols = [F.col(key).cast("long").alias(key_name),
            *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(dims)]]
    if value is not None:
        cols.append(F.col(value).cast("double").alias("val"))
    return df.select(*cols).dropna(subset=[f"x{i}" for i in range(len(dims))])


def pivot_points(levels: list[DataFrame], xs: list[str]) -> np.ndarray:
    """At most PIVOTS of the middles of the topmost boxes, each far from those before; the topmost level has FANOUT boxes at most."""
    top = levels[-1].orderBy("node").toPandas()
    mid = (top[[f"lo_{x}" for x in xs]].to_numpy(float) + top[[f"hi_{x}" for x in xs]].to_numpy(float)) / 2
    out = [int(np.argmax(((mid - mid.mean(axis=0)) ** 2).sum(axis=1)))]
    while len(out) < min(PIVOTS, len(mid)):
        out.append(int(np.argmax(squared_distances(mid, mid[out]).min(axis=1))))
    return mid[out]


def _with_pivots(df: DataFrame, xs: list[str], pivots: np.ndarray) -> DataFrame:
    """Add the distance from each pivot as ``p<i>``."""
    own = [F.col(x) for x in xs]
    return df.withColumns({f"p{i}": F.sqrt(squared_distance(own, [F.lit(float(v)) for v in at])) for i, at in enumerate(pivots)})


def touched(x: np.ndarray, own: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius2: np.ndarray,
            dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, box row) wherever the query's radius touches a box of another tile than its ``own``.

    The first ``dims`` columns are coordinates, the others distances from pivots: no point of the box is
    nearer than the greatest difference of the latter.
    """
    limit = radius2 * SLACK
    hits = ([], [])
    step = max(1, MATRIX_CELLS // max(1, len(node)))
    for s in range(0, len(x) if len(node) else 0, step):
        part = x[s:s + step]
        near = np.zeros((len(part), len(node)))
        for j in range(x.shape[1]):
            gap = np.maximum(0.0, np.maximum(lo[:, j][None, :] - part[:, j][:, None], part[:, j][:, None] - hi[:, j][None, :]))
            near = near + gap * gap if j < dims else np.maximum(near, gap * gap / SLACK)
        rows, cols = np.nonzero((near <= limit[s:s + step][:, None]) & (node[None, :] != own[s:s + step][:, None]))
        hits[0].append(rows + s)
        hits[1].append(cols)
    if not hits[0]:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(hits[0]), np.concatenate(hits[1])


def _small_lists(q: DataFrame, ref_rows: pd.DataFrame, xs, k, exclude_self) -> DataFrame:
    """(qid, own, ids, d2, vals) against a reference of bounded size."""
    ref_rows = ref_rows.sort_values("rid")
    bc = q.sparkSession.sparkContext.broadcast(
        (ref_rows[xs].to_numpy(float), ref_rows["rid"].to_numpy(), ref_rows["val"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, rid, val = bc.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rows, cols, d = nearest(columns(t, xs), t.column("qid").to_numpy(), r, rid, k, exclude_self)
            out = pa.table([t.column("qid"), t.column("own"), *lists(rows, len(t), rid[cols], d, val[cols])],
                           names=["qid", "own", "ids", "d2", "vals"])
            yield from out.combine_chunks().to_batches()
    return q.select("qid", "own", *xs).mapInArrow(run, f"qid long, own double, {FOUND}")


def _tiled_lists(q: DataFrame, r: DataFrame, n_ref: int, xs, k, exclude_self, tile_rows, same, fanout) -> tuple[DataFrame, DataFrame]:
    """(qid, own, ids, d2, vals) of queries that end with their first tile, and all found for the others with their ``tiles``."""
    spot = W.partitionBy(*xs).orderBy("rid")
    r = r.withColumn("__n", F.row_number().over(spot)).where(F.col("__n") <= k + 1).drop("__n")
    # in few dimensions all are cut alike; of many only some are cut, the widest, which tell most rows apart
    spread = None if len(xs) < PIVOT_DIMS else {x: float(v or 0.0) for x, v in r.agg(*[F.stddev_pop(x).alias(x) for x in xs]).first().asDict().items()}
    tiles = tiled(r, n_ref, xs, "rid", tile_rows, "tile", spread)
    levels = tree(boxes(tiles, "tile", xs), xs, fanout, spread=spread)
    pivots = []
    if len(xs) >= PIVOT_DIMS:
        at = pivot_points(levels, xs)
        pivots = [f"p{i}" for i in range(len(at))]
        tiles, q = _with_pivots(tiles, xs, at), _with_pivots(q, xs, at)
        levels = tree(boxes(tiles, "tile", [*xs, *pivots]), xs, fanout, pivots, spread)
    every = [*xs, *pivots]
    far, sc = F.lit(float("inf")), q.sparkSession.sparkContext
    sizes = levels[0].agg(F.sum("n").alias("n"), F.min("n").alias("least")).first()
    if same and sizes["n"] == n_ref:
        # every row of the table is in a tile, so the tiles are the query blocks and meet themselves first
        blocks = tiles.select(F.col("rid").alias("qid"), F.col("val").alias("own"), *[F.col(x).alias(x) for x in every], F.col("tile").alias("block"))
        seeds = levels[0].select(F.col("node").alias("block"), F.col("node").alias("tile"), far.alias("bound"))
        if sizes["least"] <= k:
            small = levels[0].where(F.col("n") <= k).withColumnRenamed("node", "block")
            bounds = first_tiles(small, levels, xs, k + 1).select("block", F.col("bound").alias("least"))
            seeds = seeds.join(bounds, "block", "left").select("block", "tile", F.least("bound", F.coalesce("least", far)).alias("bound"))
    else:
        n_query = q.count()
        blocks = tiled(q, n_query, xs, "qid", min(tile_rows, max(64, n_query // 64)), "block", spread)
        seeds = first_tiles(boxes(blocks, "block", xs).drop("n"), levels, xs, k + int(exclude_self))
    seeds = materialise(seeds)
    # small in bytes but heavy to compute, so the number of tasks is set here
    width = max(shuffle_width(q), min(seeds.count() // (LIGHT_BLOCKS if len(xs) < PIVOT_DIMS else BLOCKS_PER_TASK), MAX_TASKS))

    def meeting(queries: DataFrame, meets: DataFrame):
        """Query rows and tile rows of each (block, tile) that meet, brought together."""
        m = meets.select(F.col("block").alias("rblock"), F.col("tile").alias("rtile"))
        # a tile's rows are few, but their copies for all blocks are not, so the number of tasks is set here too
        rows = tiles.drop(*pivots).repartition(width, "tile").join(m.repartition(width, "rtile"), F.col("tile") == F.col("rtile")).drop("tile")
        return (queries.repartition(width, "block", "tile").groupBy("block", "tile")
                .cogroup(rows.repartition(width, "rblock", "rtile").groupBy("rblock", "rtile")))

    def found(qt: pa.Table, rt: pa.Table, limit):
        rt = rt.sort_by("rid")
        rid, val = rt.column("rid").to_numpy(), rt.column("val").to_numpy()
        rows, cols, d = nearest(columns(qt, xs), qt.column("qid").to_numpy(), columns(rt, xs), rid, k, exclude_self, limit)
        return rows, d, lists(rows, len(qt), rid[cols], d, val[cols])

    head = ["qid", "own", "block", "tile", *every]
    corners = [f"{c}_{x}" for x in every for c in ("lo", "hi")]

    def spread(qt: pa.Table, bt: pa.Table) -> pa.Table:
        """``qt`` with the tiles besides its own that each query touches, of the boxes ``bt``."""
        node = bt.column("node").to_numpy()
        rows, cols = touched(columns(qt, every), qt.column("tile").to_numpy(), node, columns(bt, [f"lo_{x}" for x in every]),
                             columns(bt, [f"hi_{x}" for x in every]), qt.column("radius2").to_numpy(), len(xs))
        return qt.append_column("tiles", lists(rows, len(qt), node[cols])[0]).drop_columns(["tile"])

    # a tree of one level has TOP boxes at most, which every task may hold
    few = sc.broadcast(levels[0].select("node", *corners).toArrow()) if len(levels) == 1 else None

    def first(qt: pa.Table, rt: pa.Table) -> pa.Table:
        rows, d, near = found(qt, rt, None)
        n = len(qt)
        last = np.searchsorted(rows, np.arange(n), side="right")
        full = last - np.searchsorted(rows, np.arange(n), side="left") == k
        edge = np.full(n, np.inf)
        edge[full] = d[last[full] - 1]
        radius = np.minimum(edge, qt.column("bound").to_numpy())
        out = pa.table([*[qt.column(c) for c in head], pa.array(radius), *near], names=[*head, "radius2", "ids", "d2", "vals"])
        return out if few is None else spread(out, few.value)

    coords = ", ".join(f"{x} double" for x in every)
    schema = f"qid long, own double, block long, {coords}, radius2 double, {FOUND}"
    begun = meeting(blocks.join(seeds, "block"), seeds)
    if few is None:
        begun = materialise(begun.applyInArrow(first, schema.replace("block long,", "block long, tile long,")))
        # the tiles that the queries of a block may touch, then those that each of them touches
        reach = boxes(begun, "block", every).join(begun.groupBy("block").agg(F.max("radius2").alias("limit2")), "block")
        around = touching(reach, levels, xs, pivots).select(F.col("block").alias("near_block"), "node", *corners)
        begun = begun.repartition(width, "block").groupBy("block").cogroup(around.repartition(width, "near_block").groupBy("near_block"))
    start = materialise(begun.applyInArrow(spread if few is None else first, f"{schema}, tiles array<long>"))

    def more(qt: pa.Table, rt: pa.Table) -> pa.Table:
        rows, _, near = found(qt, rt, qt.column("radius2").to_numpy() * SLACK)
        # queries that find nothing here have a row from their first tile
        some = np.unique(rows)
        return pa.table([qt.column("qid"), *near], names=["qid", "ids", "d2", "vals"]).take(some)

    answer = ["qid", "own", "ids", "d2", "vals", "tiles"]
    # most queries are done after their first tile and are not shuffled again
    done, going_on = start.where(F.size("tiles") == 0), start.where(F.size("tiles") > 0)
    to = going_on.select("qid", "block", "radius2", *xs, F.explode("tiles").alias("tile"))
    rest = meeting(to, to.select("block", "tile").distinct()).applyInArrow(more, f"qid long, {FOUND}")
    both = going_on.select(*answer).unionByName(rest.withColumns({"own": F.lit(None).cast("double"), "tiles": F.lit(None).cast("array<long>")}))
    return done.select(*answer), both


def _merged(both: DataFrame, k: int) -> DataFrame:
    """The k nearest of all that was found for each query."""
    nearest_first = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d2", "ids", "vals"))))
    c = both.groupBy("qid").agg(F.max("own").alias("own"), F.slice(nearest_first, 1, k).alias("c"))
    return c.select("qid", "own", F.col("c.ids").alias("ids"), F.col("c.d2").alias("d2"), F.col("c.vals").alias("vals"))


def neighbour_lists(query: DataFrame, ref: DataFrame, dims: list[str], k: int, query_key: str, ref_key: str | None = None,
                    value: str | None = None, exclude_self: bool = False, small_reference: int = SMALL_REFERENCE,
                    tile_rows: int = TILE_ROWS, own: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """``qid, own, ids, d2, vals`` per query: its column ``own`` and ids, squared distances and values of its k nearest."""
    ref_key = ref_key or query_key
    xs = [f"x{i}" for i in range(len(dims))]
    q = points(query, query_key, dims, own, "qid")
    q = q.withColumnRenamed("val", "own") if own is not None else q.withColumn("own", F.lit(None).cast("double"))
    r = points(ref, ref_key, dims, value, "rid")
    if value is None:
        r = r.withColumn("val", F.lit(0.0))
    head = r.limit(small_reference + 1).toPandas()
    if len(head) <= small_reference:
        return _small_lists(q, head, xs, k, exclude_self)
    same = query is ref and query_key == ref_key and (own is None or own == value)
    done, both = _tiled_lists(q, r, r.count(), xs, k, exclude_self, tile_rows, same, fanout)
    return done.drop("tiles").unionByName(_merged(both.drop("tiles"), k))


def tiles_touched(df: DataFrame, dims: list[str], k: int, key: str, tile_rows: int = TILE_ROWS, fanout: int = FANOUT) -> DataFrame:
    """``queries, tiles, mean_tiles, most_tiles`` that queries of a self-join go to besides their own; a flat mean makes the join scale."""
    xs = [f"x{i}" for i in range(len(dims))]
    q = points(df, key, dims, None, "qid").withColumn("own", F.lit(None).cast("double"))
    r = points(df, key, dims, None, "rid").withColumn("val", F.lit(0.0))
    n = r.count()
    done, both = _tiled_lists(q, r, n, xs, k, True, tile_rows, True, fanout)
    sizes = F.size("tiles")
    return done.select("tiles").unionByName(both.where("tiles IS NOT NULL").select("tiles")).agg(
        F.count(F.lit(1)).alias("queries"), F.lit(max(1, n // tile_rows)).alias("tiles"), F.avg(sizes).alias("mean_tiles"), F.max(sizes).alias("most_tiles"))


def knn(query: DataFrame, ref: DataFrame, dims: list[str], k: int, query_key: str, ref_key: str | None = None,
        value: str | None = None, exclude_self: bool = False, **kw) -> DataFrame:
    """``query_id, ref_id, value, distance, rank`` of the k nearest reference rows.

    ``value`` is a numeric reference column handed along; ties in distance go
    to the lower id.  Keys must be unique integers.
    """
    found = neighbour_lists(query, ref, dims, k, query_key, ref_key, value, exclude_self, **kw)
    near = F.posexplode(F.arrays_zip("d2", "ids", "vals")).alias("pos", "c")
    return found.select("qid", near).select(
        F.col("qid").alias("query_id"), F.col("c.ids").alias("ref_id"), F.col("c.vals").alias("value"),
        F.sqrt("c.d2").alias("distance"), (F.col("pos") + 1).alias("rank"))


def list_mean(values: Column) -> Column:
    """Mean of an array of numbers, null for an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(values) > 0, F.size(values))


def knn_mean(query: DataFrame, ref: DataFrame, dims: list[str], k: int, query_key: str, ref_key: str | None = None,
             value: str | None = None, exclude_self: bool = False, own: str | None = None, **kw) -> DataFrame:
    """``query_id, own, near, mean``: how many of the k nearest rows there are, and the mean of their ``value``, else of their distance.

    One row a query; no row for a neighbour is ever made.  ``own`` is a numeric query column handed along.
    """
    found = neighbour_lists(query, ref, dims, k, query_key, ref_key, value, exclude_self, own=own, **kw)
    what = F.col("vals") if value is not None else F.transform("d2", F.sqrt)
    return found.select(F.col("qid").alias("query_id"), "own", F.size("ids").alias("near"), list_mean(what).alias("mean"))
