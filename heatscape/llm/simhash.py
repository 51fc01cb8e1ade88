"""SimHash near duplicates: BK-trees over shards of fingerprints.

Fingerprints that differ in at most r bits agree in one of r + 1 blocks of bits, so a shard is a
block's value and every pair within the radius meets in a shard. Shards with many fingerprints are
divided again by the bits that are left, as often as it takes. A shard's tree has the children of
a node keyed by their integer distance to it, and a search follows only the edges within the radius.
The trees stay in the task that has built them and the fingerprints come to them: together they
grow with the documents, so no task gets all of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatscape.llm.common import kept, with_columns
from heatscape.llm.components import components

#: White space of the contract, and A-Z in lower case.
SPACES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
RADIUS = 3
#: A shard with more fingerprints is divided again.
SHARD = 1024
SHINGLES = 200_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """64 majority bits of the XXH64 of all shingles; 0 for a text without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = text.encode().translate(SPACES).split(b" ")
    parts = [p for p in parts if p]
    if not parts:
        return 0
    if len(parts) < words:
        return xxh64_intdigest(b" ".join(parts), seed)
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
    h = np.fromiter((xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), SHINGLES):
        part = h[k : k + SHINGLES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(row, fp): the input's rows and their fingerprints as signed longs. Null texts count as empty."""

    def make():
        import numpy as np
        return lambda texts: [pa.array(np.array([fingerprint(t, words, seed) for t in texts], np.uint64).view(np.int64))]

    return with_columns(docs, text_col, "fp bigint", make)


class BKTree:
    """Each node holds a fingerprint and its children by their distance to it."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def add(self, x: int) -> list[int]:
        """Fingerprints within the radius that were added before; then adds ``x``."""
        if self.root is None:
            self.root = (x, {})
            return []
        found, todo, r = [], [self.root], self.radius
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= r:
                found.append(value)
            if children:
                if len(children) <= 2 * r + 1:
                    todo.extend([c for k, c in children.items() if -r <= k - d <= r])
                else:
                    todo.extend([children[k] for k in range(d - r, d + r + 1) if k in children])
        node = self.root
        while (child := node[1].get(d := (node[0] ^ x).bit_count())) is not None:
            node = child
        node[1][d] = (x, {})
        return found


def _shard_links(batches, radius: int):
    """Links that join the fingerprints of each shard, at most one fewer than there are; rows come sorted by shard."""
    import numpy as np

    key, tree, parent = None, None, {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).tolist()
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
        a, b = [], []
        for k, x in zip(keys, fps, strict=True):
            if k != key:
                key, tree, parent = k, BKTree(radius), {}
            if x in parent:
                continue
            parent[x] = x
            for y in tree.add(x):
                p, q = find(x), find(y)
                if p != q:
                    parent[p] = q
                    a.append(x)
                    b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in (a, b)], names=["a", "b"])


def _block(rest: Column, at: int, width: int, total: int) -> tuple[Column, Column]:
    """A block of bits, and the other bits put together."""
    block = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
    high = F.lit(0).cast("bigint") if at + width >= total else F.shiftleft(F.shiftrightunsigned(rest, at + width), at)
    low = rest.bitwiseAND(F.lit((1 << at) - 1).cast("bigint"))
    return block, high.bitwiseOR(low)


def _divided(rows: DataFrame, total: int, blocks: int) -> tuple[DataFrame, int]:
    """Every row once for each block of its remaining bits; (key, fp, rest) and the bits that remain."""
    width = total // blocks
    made = []
    for i in range(blocks):
        # the last block takes what is left over; all leave as many bits, those of the last block's surplus count as zero
        wide = width if i < blocks - 1 else total - width * (blocks - 1)
        block, rest = _block(F.col("rest"), i * width, wide, total)
        made.append(F.struct(F.xxhash64("key", F.lit(i), block).alias("key"), rest.alias("rest")))
    out = rows.select("fp", F.explode(F.array(*made)).alias("x"))
    return out.select(F.col("x.key").alias("key"), "fp", F.col("x.rest").alias("rest")), total - width


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links within ``radius`` that join the distinct longs of ``fps`` (column fp) as all such links do."""
    spark = fps.sparkSession
    rows, bits = fps.select(F.lit(0).cast("bigint").alias("key"), "fp", F.col("fp").alias("rest")), 64
    ready = []
    while True:
        rows, bits = _divided(rows, bits, radius + 1)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
        big = kept(sizes.where(F.col("n") > shard).select("key"), "large-shards")
        if bits < 2 * (radius + 1) or big.isEmpty():
            ready.append(rows.select("key", "fp"))
            break
        ready.append(rows.join(big, "key", "left_anti").select("key", "fp"))
        rows = kept(rows.join(big, "key", "left_semi"), "divided")
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (whole.repartition(shards, "key").sortWithinPartitions("key", "fp")
            .mapInArrow(lambda batches: _shard_links(batches, radius), "a bigint, b bigint"))


def groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(row, fp, component_id): component_id is the smallest id that links within the radius reach.

    Texts without words have fingerprint zero and link like others. A row without an id is never
    the smallest; a group of such rows alone has a null component_id. Copies count once until the
    end, so a group of any size costs one fingerprint for each different text.
    """
    rows = kept(fingerprints(docs, text_col), "fingerprints")
    lowest = rows.groupBy("fp").agg(F.min(F.col(f"row.`{id_col}`")).alias("low"))
    lowest = kept(lowest, "distinct")
    joined = kept(components(links(lowest.select("fp"), radius)), "components")
    roots = joined.join(lowest, joined["node"] == lowest["fp"]).groupBy("root").agg(F.min("low").alias("low"))
    named = joined.join(roots, "root").select(F.col("node").alias("fp"), F.col("low").alias("group_low"))
    label = lowest.join(named, "fp", "left").select("fp", F.coalesce("group_low", "low").alias("component_id"))
    return rows.join(label, "fp").select("row", "fp", "component_id")


def representatives(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row of each group: that of the smallest id; of repeated ids, and where no row has one, the smallest text."""
    rows = groups(docs, text_col, id_col, radius)
    own = F.col(f"row.`{id_col}`")
    first = rows.where(own.eqNullSafe(F.col("component_id")))
    # repeated ids, and rows without one, are few or none; only they are compared
    again = kept(first.groupBy(own.alias("id"), F.when(own.isNull(), F.col("fp")).alias("fp")).count().where("count > 1"), "repeated")
    if again.isEmpty():
        return first.select("row.*")
    keys = [own.eqNullSafe(F.col("again.id")), F.when(own.isNull(), F.col("first.fp")).eqNullSafe(F.col("again.fp"))]
    first, again = first.alias("first"), again.alias("again")
    plain = first.join(again, keys, "left_anti").select("row.*")
    order = F.row_number().over(Window.partitionBy(own, F.when(own.isNull(), F.col("first.fp"))).orderBy(F.col(f"row.`{text_col}`"), F.xxhash64("row")))
    chosen = first.join(again, keys, "left_semi").withColumn("n", order).where("n = 1").select("row.*")
    return plain.unionByName(chosen)


def fingerprint_text() -> Column:
    return F.lpad(F.lower(F.hex("fp")), 16, "0")
