"""Tiles of neighbouring rows, and a tree of boxes over them that is joined, never broadcast.

A table is cut into tiles of at most ``TILE_ROWS`` rows by range shuffles on one coordinate after the
other, so a dense spot simply gets more tiles.  Bounding boxes of tiles are rows; neighbouring boxes have
a common box, and so on up to at most ``FANOUT`` of them.  A block of queries walks down that tree by one
equi-join a level and goes on only below boxes it may need, so no task and no driver sees all boxes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.functions.columns import add
from heatscape.functions.ranking import shuffle_width
from heatscape.session import materialise

TILE_ROWS = 1024
TILE_DIMS = 3
FANOUT = 64
#: Boxes that all blocks meet; a tree of no more tiles has one level.
TOP = 256
# Bounds are compared after rounding in another order than the distances
# themselves, so boxes are kept a little too long rather than too short.
SLACK = 1.0 + 1e-9


def cuts_of(spread: dict[str, float], n_tiles: int) -> dict[str, float]:
    """The coordinates that are cut, widest first, and into how many parts each, so that tiles are about as wide in one as in another."""
    wide = sorted(((v, x) for x, v in spread.items() if v > 0), key=lambda c: (-c[0], c[1]))[:TILE_DIMS]
    while wide:
        side = (math.prod(v for v, _ in wide) / n_tiles) ** (1 / len(wide))
        if len(wide) == 1 or wide[-1][0] >= side:
            return {x: v / side for v, x in wide}
        wide.pop()
    return {next(iter(spread)): float(n_tiles)}


def tiled(df: DataFrame, n_rows: int, xs: list[str], key: str, tile_rows: int, name: str, spread: dict[str, float] | None = None) -> DataFrame:
    """Add a tile number such that a tile holds neighbouring rows, at most ``tile_rows``.

    The first coordinates are cut into as many parts each, or by ``spread`` the widest ones into parts as wide.
    """
    n_tiles = max(1, n_rows // tile_rows)
    cuts = {x: n_tiles ** (1 / len(xs[:TILE_DIMS])) for x in xs[:TILE_DIMS]} if spread is None else cuts_of(spread, n_tiles)
    cut_dims = list(cuts)
    strip: list[str] = []
    for j, x in enumerate(cut_dims[:-1]):
        parts = max(1, int(round(math.prod(list(cuts.values())[: j + 1]))))
        rest = [c for c in xs if c != x]
        df = df.repartitionByRange(parts, *strip, x, *rest, key).withColumn("__strip", F.spark_partition_id())
        strip = ["__strip"]
    order = [*strip, cut_dims[-1], key]
    width = min(n_tiles, max(shuffle_width(df), n_rows // 1_000_000))
    df = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # a place is (partition << 33) + position, so blocks never cross partitions
    block = F.floor(F.monotonically_increasing_id() / F.lit(tile_rows)).cast("long")
    tile = F.shiftleft(block, 20) + (F.col("__strip") if strip else F.lit(0))
    return materialise(df.withColumn(name, tile.cast("long")).drop("__strip"))


def boxes(df: DataFrame, tile: str, xs: list[str]) -> DataFrame:
    return df.groupBy(tile).agg(F.count(F.lit(1)).alias("n"),
                                *[F.min(x).alias(f"lo_{x}") for x in xs],
                                *[F.max(x).alias(f"hi_{x}") for x in xs])


def tree(tile_boxes: DataFrame, xs: list[str], fanout: int = FANOUT, more: list[str] = (), spread: dict[str, float] | None = None) -> list[DataFrame]:
    """Levels of (node, parent, n, lo_*, hi_*), the tiles first; the last has at most ``TOP`` nodes, or ``fanout``, with parent 0.

    Boxes that are near in ``xs`` go together; the ranges of ``more`` are kept as well.
    """
    corners = [f"{c}_{x}" for x in [*xs, *more] for c in ("lo", "hi")]
    nodes = materialise(tile_boxes.select(F.col("tile").alias("node"), "n", *corners))
    levels = []
    while (count := nodes.count()) > (TOP if fanout == FANOUT else fanout):
        middles = nodes.withColumns({f"mid_{x}": (F.col(f"lo_{x}") + F.col(f"hi_{x}")) / 2 for x in xs})
        own = None if spread is None else {f"mid_{x}": v for x, v in spread.items()}
        level = tiled(middles, count, [f"mid_{x}" for x in xs], "node", fanout, "parent", own).select("node", "parent", "n", *corners)
        levels.append(level)
        above = level.groupBy(F.col("parent").alias("node")).agg(
            F.sum("n").alias("n"), *[(F.min if c[:3] == "lo_" else F.max)(c).alias(c) for c in corners])
        nodes = materialise(above.select("node", "n", *corners))
    return [*levels, nodes.withColumn("parent", F.lit(0).cast("long")).select("node", "parent", "n", *corners)]


def near2(xs: list[str]) -> Column:
    """Squared distance of a block's box (``b_``) from a node's box."""
    return add([F.pow(F.greatest(F.lit(0.0), F.col(f"lo_{x}") - F.col(f"b_hi_{x}"), F.col(f"b_lo_{x}") - F.col(f"hi_{x}")), 2) for x in xs])


def far2(xs: list[str]) -> Column:
    """Squared distance of the farthest two corners of both boxes."""
    return add([F.pow(F.greatest(F.abs(F.col(f"b_hi_{x}") - F.col(f"lo_{x}")), F.abs(F.col(f"hi_{x}") - F.col(f"b_lo_{x}"))), 2) for x in xs])


def as_blocks(box_rows: DataFrame, xs: list[str], *more: str) -> DataFrame:
    """Boxes of blocks under the names that the walk uses."""
    return box_rows.select("block", *more, *[F.col(f"{c}_{x}").alias(f"b_{c}_{x}") for x in xs for c in ("lo", "hi")])


def _meeting(frontier: DataFrame, level: DataFrame, xs: list[str]) -> DataFrame:
    """Blocks with all children of the nodes they have come to, and the two distances."""
    rows = frontier.join(level, frontier["at"] == level["parent"]).drop("at", "parent")
    return rows.withColumns({"near2": near2(xs), "far2": far2(xs)})


def touching(blocks: DataFrame, levels: list[DataFrame], xs: list[str], pivots: list[str] = ()) -> DataFrame:
    """(block, node, n, lo_*, hi_*): every tile whose box is within ``limit2`` of a block's box.

    ``pivots`` are distances from fixed points: two points are no nearer than their difference.
    """
    corners = [f"{c}_{x}" for x in [*xs, *pivots] for c in ("lo", "hi")]
    here = as_blocks(blocks, [*xs, *pivots], "limit2")
    frontier = here.withColumn("at", F.lit(0).cast("long"))
    within = F.col("near2") <= F.col("limit2") * SLACK
    for p in pivots:
        within = within & (near2([p]) <= F.col("limit2") * SLACK * SLACK)
    for depth, level in enumerate(reversed(levels)):
        met = _meeting(frontier, level, xs).where(within)
        if depth == len(levels) - 1:
            return met.select("block", "node", "n", *corners)
        frontier = met.withColumnRenamed("node", "at").select(*here.columns, "at")
    raise ValueError("a tree has one level at least")


def _bounded(met: DataFrame) -> DataFrame:
    """Add ``least2`` and ``most2``, between which the ``need``-th row of a block's every query lies.

    ``need`` counts the rows still to be found among these nodes; both are infinite if there are too few.
    """
    by_near = F.sum("n").over(W.partitionBy("block").orderBy("near2", "node"))
    by_far = F.sum("n").over(W.partitionBy("block").orderBy("far2", "node"))
    whole = W.partitionBy("block")
    far = F.lit(float("inf"))
    rows = met.withColumns({"__near": by_near, "__far": by_far})
    return rows.withColumns({
        "least2": F.coalesce(F.min(F.when(F.col("__near") >= F.col("need"), F.col("near2"))).over(whole), far),
        "most2": F.coalesce(F.min(F.when(F.col("__far") >= F.col("need"), F.col("far2"))).over(whole), far)}).drop("__near", "__far")


def first_tiles(blocks: DataFrame, levels: list[DataFrame], xs: list[str], need: int) -> DataFrame:
    """(block, tile, bound): the tile nearest to a block as a whole, and a squared radius sure to hold ``need`` rows."""
    here = as_blocks(blocks, xs).withColumn("need", F.lit(need).cast("long"))
    frontier = here.withColumn("at", F.lit(0).cast("long"))
    for level in reversed(levels):
        met = _bounded(_meeting(frontier, level, xs)).where(F.col("near2") <= F.col("most2") * SLACK)
        frontier = met.withColumnRenamed("node", "at").select(*here.columns, "at")
    return met.groupBy("block").agg(F.min_by("node", F.struct("far2", "node")).alias("tile"), (F.max("most2") * SLACK).alias("bound"))


def covering(blocks: DataFrame, levels: list[DataFrame], xs: list[str], need: int) -> DataFrame:
    """(block, level, node, n, inside): how the ``need`` nearest rows of each query of a block are covered.

    Nodes with ``inside`` lie wholly nearer than the ``need``-th row of every query of the block, as high in
    the tree as possible.  The others are the tiles that may hold that row or lie on both sides of it.
    """
    here = as_blocks(blocks, xs).withColumn("need", F.lit(need).cast("long"))
    frontier, out = here.withColumn("at", F.lit(0).cast("long")), None
    for depth, level in enumerate(reversed(levels)):
        met = _bounded(_meeting(frontier, level, xs)).where(F.col("near2") <= F.col("most2") * SLACK)
        inside = F.col("far2") * SLACK < F.col("least2")
        last = depth == len(levels) - 1
        met = materialise(met.withColumn("inside", inside))
        found = met if last else met.where("inside")
        found = found.select("block", F.lit(len(levels) - 1 - depth).alias("level"), "node", "n", "inside")
        out = found if out is None else out.unionByName(found)
        # what is inside need not be looked for among the other nodes
        have = F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))).over(W.partitionBy("block")), F.lit(0))
        frontier = (met.withColumn("need", F.col("need") - have).where(~F.col("inside"))
                    .withColumnRenamed("node", "at").select(*here.columns, "at"))
    return out
