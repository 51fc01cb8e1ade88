"""Near-duplicate vectors, all pairs of them, by shards that vectors visit.

The shard of a vector is that of its nearest centre. A vector also visits every shard that can hold
one it links with: two unit vectors of cosine t are at most sqrt(2 - 2t) apart, so a vector farther
than that beyond the plane between two centres links with none on the other side. Vectors of a shard
are compared with each other and with the visitors, so no link is lost, and each pair meets once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import kept
from heatscape.llm.components import components
from heatscape.session import ship_package

THRESHOLD = 0.98
#: Vectors of a shard, of a block of a shard that is too large, and visitors of a task.
SHARD, BLOCK, VISITORS = 1500, 1500, 3000
#: Planes tried for a vector and a shard: between that shard's centre and each of the vector's nearest ones.
PLANES = 8
#: Vectors that centres are chosen from at most, a label; their distribution sets shards only, no result is limited to them.
FIT_ROWS = 4_000
FLOOR = 1e-9


def _unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def valid(col: str = "embedding"):
    """Vectors without null or non-finite components that aren't zero."""
    x = F.col(f"`{col}`").cast("array<double>")
    return (x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _centres(classes: DataFrame) -> dict:
    """Centres of each (label, size) as unit rows: one for every SHARD vectors, spread by k-means on a bounded sample."""
    sizes = {(r["label"], r["size"]): r["n"] for r in classes.groupBy("label", "size").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    out = {}
    for (label, size), n in sizes.items():
        rows = (classes.where((F.col("label") == label) & (F.col("size") == size)).orderBy(F.xxhash64("class"), "class").limit(FIT_ROWS)
                .select("v").toArrow())
        x = _unit(_matrix(rows["v"]))
        k = min(len(x), -(-n // SHARD), 1024)
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(6):
            near = np.argmax(x @ c.T, axis=1)
            for j in range(k):
                if (near == j).any():
                    c[j] = x[near == j].mean(axis=0)
            norm = np.sqrt((c * c).sum(axis=1, keepdims=True))
            c = np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), x[:1])
        out[label, size] = c
    return out


def _visits(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shard of each unit row, and the later shards that can hold rows within the threshold of it."""
    sims = x @ c.T
    reach = np.sqrt(max(2 - 2 * threshold, 0)) + FLOOR
    first = np.argmax(sims, axis=1)
    near = np.argsort(-sims, axis=1, kind="stable")[:, :PLANES]
    may = np.arange(len(c))[None] > first[:, None]
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(axis=2), 0)) if len(c) <= 128 else np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
    for k in range(near.shape[1]):
        may &= np.take_along_axis(sims, near[:, k : k + 1], axis=1) - sims <= reach * apart[near[:, k]] + 1e-7
    return first, [np.flatnonzero(m) for m in may]


def _placed(classes: DataFrame, centres: dict, threshold: float) -> DataFrame:
    """Each class with its shard and those it visits: (label, size, shard, visits, class, copies, v)."""
    given = classes.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            shard, visits = np.zeros(len(keys), np.int32), [np.zeros(0, int)] * len(keys)
            for key in dict.fromkeys(keys):
                c = given.value.get(key)
                if c is None:
                    continue
                rows = np.flatnonzero([k == key for k in keys])
                for part in np.array_split(rows, -(-len(rows) // 1024)):
                    first, later = _visits(_unit(_matrix(batch.column(4).take(pa.array(part)))), c, threshold)
                    shard[part] = first
                    for r, to in zip(part, later, strict=True):
                        visits[r] = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard), pa.array(visits, pa.list_(pa.int32())),
                                              batch.column(2), batch.column(3), batch.column(4)],
                                             names=["label", "size", "shard", "visits", "class", "copies", "v"])

    return classes.select("label", "size", "class", "copies", "v").mapInArrow(
        run, "label int, size int, shard int, visits array<int>, class bigint, copies bigint, v array<double>")


GROUP = ["label", "size", "shard"]


def _meetings(placed: DataFrame) -> DataFrame:
    """(label, size, shard, block, chunk, home, class, copies, v): who is compared in each task.

    The rows of a shard that is too large are cut into blocks, and a block is visited by those of
    earlier blocks too; many visitors are cut into chunks, each of which meets the whole block.
    """
    rows = ["class", "copies", "v"]
    came = placed.select("label", "size", F.explode("visits").alias("shard"), *rows)
    sizes = placed.groupBy(*GROUP).agg(F.count("*").alias("n")).join(came.groupBy(*GROUP).agg(F.count("*").alias("m")), GROUP, "left")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    guests = F.coalesce("m", F.lit(0)) + F.when(blocks > 1, F.col("n")).otherwise(0)
    plan = kept(sizes.select(*GROUP, blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(guests / VISITORS)).cast("int").alias("chunks")), "plan")
    chunk = F.pmod(F.xxhash64("class", F.lit(1)), F.col("chunks")).cast("int").alias("chunk")
    own = placed.select(*GROUP, *rows).join(plan, GROUP).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    home = own.select(*GROUP, "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("home"), *rows)
    beside = own.where("block < blocks - 1").select(
        *GROUP, F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), chunk, F.lit(False).alias("home"), *rows)
    others = came.join(plan, GROUP).select(
        *GROUP, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), chunk, F.lit(False).alias("home"), *rows)
    return home.unionByName(beside).unionByName(others)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each unit row of ``x`` is within the threshold of each of ``y``."""
    out = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), 512):
        sims = x[at : at + 512] @ y.T
        out[at : at + 512] = sims >= threshold
        i, j = np.nonzero(np.abs(sims - threshold) <= FLOOR)
        for s in range(0, len(i), 4096):
            # sums in a fixed order where the last digits decide
            p, q = i[s : s + 4096], j[s : s + 4096]
            out[at + p, q] = (x[at + p] * y[q]).sum(axis=1) >= threshold
    return out


def _found(meetings: DataFrame, threshold: float) -> DataFrame:
    """(a, links, joined) of what each task compares.

    ``links`` are numbers of linked vectors, ``joined`` the links that hold the found components together.
    """

    def run(table):
        table = table.sort_by([("home", "descending"), ("class", "ascending")])
        names, x, copies = table["class"].to_numpy(), _unit(_matrix(table["v"])), table["copies"].to_numpy().astype(float)
        n = int(table["home"].to_numpy(zero_copy_only=False).sum())
        both = np.zeros((len(x), len(x)), bool)
        if not int(table["chunk"][0].as_py()):  # rows at home meet each other in one of their tasks
            both[:n, :n] = linked(x[:n], x[:n], threshold)
            np.fill_diagonal(both, False)
            both[:n, :n] |= both[:n, :n].T
        both[n:, :n] = linked(x[n:], x[:n], threshold)
        both[:n, n:] = both[n:, :n].T
        links = np.concatenate([np.zeros(0), *[both[at : at + 512].astype(float) @ copies for at in range(0, len(x), 512)]]).astype(np.int64)
        joined: list[list[int]] = [[] for _ in names]
        new = np.ones(len(x), bool)
        for i in np.flatnonzero(links):
            if not new[i]:
                continue
            new[i], todo = False, [i]
            while todo:
                k = todo.pop()
                more = np.flatnonzero(both[k] & new)
                new[more] = False
                joined[k] += names[more].tolist()
                todo += more.tolist()
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(names[some], pa.int64()), "links": pa.array(links[some], pa.int64()),
                         "joined": pa.array([joined[k] for k in some], pa.list_(pa.int64()))})

    return meetings.groupBy(*GROUP, "block", "chunk").applyInArrow(run, "a bigint, links bigint, joined array<bigint>")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``.
    Vectors that are null, zero or hold null or non-finite components, and vectors of unlike
    length, link with nothing. Equal vectors of a label are one class with its number of copies
    and are not compared with each other. Rows without an id link but are never a component's
    name; a component of such rows alone has none and they are not kept. Repeated ids are rows like others.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").cast("int").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("v"), valid(vector_col).alias("fit"))
    rows = rows.withColumn("fit", F.coalesce("fit", F.lit(False)) & F.col("label").isNotNull())
    # minus zero equals zero
    rows = rows.withColumn("code", F.when(F.col("fit"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256)))
    rows = kept(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("fit").groupBy("code").agg(F.min("uid").alias("class"), F.count("*").alias("copies"), F.min("vec_id").alias("low"),
                                                    F.min("label").alias("label"), F.min_by("v", "uid").alias("v"))
    classes = kept(classes.withColumn("size", F.size("v")), "classes")
    placed = kept(_placed(classes, _centres(classes), threshold), "placed")
    found = kept(_found(_meetings(placed), threshold), "found")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = kept(components(found.select("a", F.explode("joined").alias("b"))), "components")
    named = classes.join(counts, classes["class"] == counts["a"], "left").join(joined, classes["class"] == joined["node"], "left").select(
        "code", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"), "low")
    named = kept(named, "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    label = named.join(lowest, "root").select("code", "n_links", "component_id")
    linked = rows.where("fit").join(label, "code").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fit").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def recall(vectors: DataFrame, found: DataFrame, every: int = 50, threshold: float = THRESHOLD, block: int = 2_000) -> float:
    """Share of true links of vectors whose id is divisible by ``every`` that ``found`` counts, by brute force in blocks of queries."""
    rows = vectors.where(F.coalesce(valid(), F.lit(False)) & F.col("label").isNotNull())
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    true = have = 0
    some = queries.toArrow()
    for at in range(0, len(some), block):
        part = some.slice(at, block)
        given = vectors.sparkSession.sparkContext.broadcast((part["vec_id"].to_numpy(), part["label"].to_numpy(), _unit(_matrix(part["v"]))))

        def run(batches):
            ids, labels, q = given.value
            total = np.zeros(len(ids), np.int64)
            for batch in batches:
                x = _unit(_matrix(batch.column(2)))
                same = labels[:, None] == batch.column(1).to_numpy()[None]
                total += ((q @ x.T >= threshold) & same & (ids[:, None] != batch.column(0).to_numpy()[None])).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "n": total})

        counts = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "vec_id bigint, n bigint")
        both = counts.groupBy("vec_id").agg(F.sum("n").alias("n")).join(found, "vec_id").agg(
            F.sum("n").alias("n"), F.sum(F.least("n", "n_links")).alias("m")).first()
        true, have = true + (both["n"] or 0), have + (both["m"] or 0)
    return have / true if true else 1.0
