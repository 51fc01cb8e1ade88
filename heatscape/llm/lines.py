"""Line deduplication: lines that are nearly alike, by MinHash of character shingles.

Lines are compared without case, with one space for each run of spaces and control characters. A line's shingles are the five characters
from every position, whatever words are; a shorter line is its own. Signatures of minima are cut into bands; lines that agree in a band are candidates, the Jaccard index of their shingle sets
is computed exactly for all that sketches of the sets do not tell apart, and links are joined to components, of which the first line stays. Spark shuffles, joins
and groups lines, buckets and links; shingles are hashed and compared by numpy on Arrow batches, because their number is that of the
characters: as rows or arrays of the engine, 36 minima of each cost more than twice the time that is allowed for all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heatscape.llm.common import bucketed, kept, slices
from heatscape.llm.components import components
from heatscape.session import ship_package

WIDTH = 5
#: Characters of a piece of a line, and of the pieces that a task holds as numbers at once.
PIECE = 1_000_000
#: Odd multipliers of a shingle's characters and of the last mixing; NONE stands behind a line's end.
TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
NONE = 0x110000
#: Short shingles are shared by more lines than long ones, so a band has four minima.
BANDS, ROWS = 9, 4
SIMILAR = 0.8
#: Lines of a block that meets another one, and bytes of sketches that meet at once.
MEET_LINES, MEET_BYTES = 4096, 8_000_000


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def plain(line: Column) -> Column:
    """A line in lower case, with one space between words and none around them."""
    uneven = F.contains(line, F.lit("  ")) | line.rlike(r"[\x00-\x1F]")
    return F.trim(F.lower(F.when(uneven, F.regexp_replace(line, r"[\x00-\x20]{2,}|[\x00-\x1F]", " ")).otherwise(line)))


def pieces(line: str) -> list[str]:
    """Parts of a line that together hold the shingles of every position once."""
    if len(line) <= PIECE:
        return [line]
    return [line[at : at + PIECE + WIDTH - 1] for at in range(0, len(line) - WIDTH + 1, PIECE)]


def shingle_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all parts, and where each part's begin; a part shorter than a shingle is its own."""
    codes = np.frombuffer(("\0" * WIDTH).join([*parts, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + WIDTH) - WIDTH
    codes[(ends[:, None] + np.arange(WIDTH)).ravel()] = NONE
    h = np.zeros(len(codes) - WIDTH + 1, np.uint64)
    for j, times in enumerate(TIMES):
        h += codes[j : j + len(h)] * np.uint64(times)
    whole = np.maximum(sizes - WIDTH + 1, 1)
    begins = np.cumsum(whole) - whole
    h = h[np.arange(whole.sum()) + np.repeat(ends - sizes - begins, whole)]
    for times in MIX:
        h ^= h >> np.uint64(33)
        h *= np.uint64(times)
    return h ^ (h >> np.uint64(33)), begins


def minima(lines: list[str], n: int) -> np.ndarray:
    """``n`` minima of each line's shingles, one row for each line.

    A shingle is hashed once, to 64 bits, of which one half steps along the other: h0 + k * h1 modulo
    2^32 stands for the k-th hash, which is uniform for each k and independent for any two of them.
    """
    parts = [pieces(x) for x in lines]
    flat = [x for some in parts for x in some]
    out = np.empty((n, len(flat)), np.uint32)
    for a, b in slices(flat, PIECE):
        h, begins = shingle_hashes(flat[a:b])
        # an odd step meets every number once
        value, step = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for k in range(n):
            out[k, a:b] = np.minimum.reduceat(value, begins)
            value += step
    first = np.cumsum([0, *map(len, parts[:-1])]) if parts else []
    return np.minimum.reduceat(out, first, axis=1).T if flat else out.T


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """Distinct hashes of each line's shingles, sorted."""
    out = []
    for a, b in slices(lines, PIECE):
        if len(lines[a]) > PIECE:
            out.append(np.unique(np.concatenate([np.unique(shingle_hashes([x])[0]) for x in pieces(lines[a])])))
            continue
        h, begins = shingle_hashes(lines[a:b])
        bounds = [*begins.tolist(), len(h)]
        for i, j in zip(bounds, bounds[1:]):
            h[i:j].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[begins] = True
        ends = np.cumsum(new)[np.array(bounds[1:]) - 1].tolist()
        h = h[new]
        out += [h[i:j] for i, j in zip([0, *ends[:-1]], ends)]
    return out


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """Numbers that two sorted sets have in common."""
    both = np.concatenate([p, q])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def band_keys(lines: DataFrame) -> DataFrame:
    """(line, keys): a key for each band of the signature of each distinct line (line, words)."""
    ship_package(lines.sparkSession)

    def run(batches):
        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in slices(words):
                found = minima(words[a:b], BANDS * ROWS).astype(np.uint64).reshape(b - a, BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (b - a, BANDS)).copy()
                for r in range(ROWS):
                    keys = (keys ^ found[:, :, r]) * np.uint64(TIMES[r])
                    keys ^= keys >> np.uint64(29)
                ends = pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64)))],
                                                 names=["line", "keys"])

    return lines.select("line", "words").mapInArrow(run, "line bigint, keys array<bigint>")


def similar_pairs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(a, b, index, same) of pairs (a, b): the exact Jaccard index of their shingle sets, which 64-bit hashes stand for.

    Lines travel to their pairs as texts, which are an eighth of their sets; pairs come in order of
    ``a``, so that the set of a line that meets many is made once a batch of them.
    """
    ship_package(lines.sparkSession)
    both = (pairs.join(lines.select(F.col("line").alias("b"), F.col("words").alias("q")), "b")
            .join(lines.select(F.col("line").alias("a"), F.col("words").alias("p")), "a"))

    def run(batches):
        for batch in batches:
            ends, others = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            last, known = None, None
            for s, e in slices(others, PIECE):
                index, same = [], []
                for k, q in zip(range(s, e), shingle_sets(others[s:e]), strict=True):
                    if known is None or ends[k] != last:
                        last, known = ends[k], shingle_sets([batch.column(2)[k].as_py()])[0]
                    both = shared(known, q)
                    either = len(known) + len(q) - both
                    index.append(both / either)
                    same.append(both >= SIMILAR * either)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), pa.array(index, pa.float64()),
                                                  pa.array(same, pa.bool_())], names=["a", "b", "index", "same"])

    return both.select("a", "b", "p", "q").mapInArrow(run, "a bigint, b bigint, index double, same boolean")


def sketches(sets: list[np.ndarray]) -> pa.Array:
    """For each set of hashes, one bit for each of about as many slots: whether an odd number of its hashes is in the slot."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    slots = np.maximum(64, 1 << np.round(np.log2(sizes)).astype(np.int64))
    ends = np.cumsum(slots)
    at = (np.concatenate(sets) & np.repeat((slots - 1).astype(np.uint64), sizes)).astype(np.int64) + np.repeat(ends - slots, sizes)
    odd = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(np.concatenate([[0], ends // 8]).astype(np.int32)), pa.py_buffer(odd)])


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows, bytes) as of fewer slots: both halves of a sketch put together are that of half the slots."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_be_alike(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """False where the sketches tell that sets of ``n`` and ``m`` hashes are not alike.

    A slot in which sketches differ holds a hash that only one of the sets has, and so does each
    hash that one set has more; alike sets have no more of these than (1 - t) / (1 + t) of their
    sizes' sum, so no alike pair is turned down.
    """
    differ = np.bitwise_count(np.ascontiguousarray(p).view(np.uint64) ^ np.ascontiguousarray(q).view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return np.maximum(differ, np.abs(n - m)) * (1 + SIMILAR) <= (n + m) * (1 - SIMILAR) * (1 + 1e-9)


def _sketch_rows(found: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places, sketches) of each length of sketch."""
    widths = np.fromiter(map(len, found), np.int64, len(found))
    return {int(w): (at, np.frombuffer(b"".join([found[i] for i in at]), np.uint8).reshape(len(at), w))
            for w in np.unique(widths) for at in [np.flatnonzero(widths == w)]}


def sketched(lines: DataFrame) -> DataFrame:
    """(line, n, sketch): the number of shingles and the sketch of each line (line, words)."""
    ship_package(lines.sparkSession)

    def run(batches):
        for batch in batches:
            words = batch.column(1).to_pylist()
            for a, b in slices(words, PIECE):
                sets = shingle_sets(words[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(map(len, sets)), pa.int64()),
                                                  sketches(sets)], names=["line", "n", "sketch"])

    return lines.select("line", "words").mapInArrow(run, "line bigint, n bigint, sketch binary")


def hopeful(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be alike by the sketches of ``marks``."""
    ship_package(marks.sparkSession)
    both = (pairs.join(marks.select(F.col("line").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("q")), "b")
            .join(marks.select(F.col("line").alias("a"), "n", F.col("sketch").alias("p")), "a"))

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            ours, theirs = _sketch_rows(batch.column(4).to_pylist()), _sketch_rows(batch.column(5).to_pylist())
            keep = np.zeros(len(n), bool)
            for i, p in ours.values():
                for j, q in theirs.values():
                    at, x, y = np.intersect1d(i, j, assume_unique=True, return_indices=True)
                    if len(at):
                        width = min(p.shape[1], q.shape[1])
                        keep[at] = may_be_alike(n[at], m[at], folded(p[x], width), folded(q[y], width))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a bigint, b bigint")


def _meetings(line: np.ndarray, root: np.ndarray, part: np.ndarray, n: np.ndarray, found: list[bytes]):
    """(a, b) of the lines of a group that may be alike and are not joined yet; lines of two parts meet those of the other."""
    ours = _sketch_rows(found)
    across = part.min() != part.max()
    for i, p in ours.values():
        for j, q in ours.values():
            if p.shape[1] > q.shape[1]:
                continue
            short = folded(q, p.shape[1])
            step = max(1, MEET_BYTES // max(1, short.size))
            for s in range(0, len(i), step):
                x = i[s : s + step]
                hit = may_be_alike(n[x][:, None], n[j][None, :], p[s : s + step, None, :], short[None, :, :])
                hit &= root[x][:, None] != root[j][None, :]
                if across:
                    hit &= part[x][:, None] != part[j][None, :]
                at, to = np.nonzero(hit)
                if len(at):
                    yield np.minimum(line[x[at]], line[j[to]]), np.maximum(line[x[at]], line[j[to]])


def open_pairs(told: DataFrame, marks: DataFrame, block: int | None = None) -> DataFrame:
    """(a, b): pairs of a bucket's lines that may be alike and are not joined yet.

    Lines (key, line, root, place, n_lines) of a bucket meet in blocks: a task holds two of them, and
    only pairs that the sketches do not tell apart become rows.
    """
    ship_package(marks.sparkSession)
    block = block or MEET_LINES
    many = F.ceil(F.col("n_lines") / block).cast("int")
    own = F.floor(F.col("place") / block).cast("int")
    rows = told.select("line", "root", own.alias("part"), "key", F.explode(F.sequence(F.lit(0), many - 1)).alias("other"))
    rows = rows.join(marks, "line").select(
        F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("meet"), (F.col("part") != F.col("other")).alias("across"), "part", "line", "root", "n", "sketch")
    width = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "meet").sortWithinPartitions("meet", "part", "line")

    def pairs_of(t: pa.Table, meet: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1], True]) if len(meet) else np.zeros(0, int)
        line, root, part, n, across = (t.column(c).to_numpy() for c in ("line", "root", "part", "n", "across"))
        sketch = t.column("sketch").to_pylist()
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # a block whose other one has no lines, or a group that has nothing to look for
            if (root[s:e] == root[s]).all() or (across[s] and part[s] == part[e - 1]):
                continue
            for a, b in _meetings(line[s:e], root[s:e], part[s:e], n[s:e], sketch[s:e]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        left = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            meet = t.column("meet").to_numpy()
            # the last group may go on in the next batch
            last = int(np.searchsorted(meet, meet[-1])) if len(meet) else 0
            yield from pairs_of(t.slice(0, last), meet[:last])
            left = t.slice(last)
        if left is not None:
            yield from pairs_of(left, left.column("meet").to_numpy())

    return rows.mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b): verified links that join all alike lines of each bucket.

    All lines of a bucket are compared with one of them, its head, and those alike it are joined.
    Then all lines of a bucket that are not joined yet, by their own links or by those of others,
    are compared with each other. Sketches, which are much smaller than lines, turn down most pairs
    that are not alike and none that are; only the others' lines travel and are compared exactly.
    """
    ordered = keys.select("line", F.explode("keys").alias("key"))
    # the head is the least name, the same line in many of a group's buckets, so that few pairs differ;
    # a bucket is sorted, not held: lines go by, and those that are alone in theirs go no further
    bucket = W.partitionBy("key")
    members = ordered.select("key", "line", F.first("line").over(bucket.orderBy("line")).alias("head"), F.count("line").over(bucket).alias("n"),
                             F.row_number().over(bucket.orderBy("line")).alias("nth")).where("line != head")
    # the head has met all others: it is no place
    members = kept(members.select("key", "line", "head", (F.col("n") - 1).alias("n_lines"), (F.col("nth") - 2).alias("place")), "pairs")
    first = members.select(F.col("head").alias("a"), F.col("line").alias("b")).distinct()
    wanted = members.select(F.explode(F.array("head", "line")).alias("line")).distinct()
    marks = bucketed(sketched(distinct.join(wanted, "line", "left_semi")), "line", "sketches")
    found = similar_pairs(hopeful(first, marks), distinct).where("same").select("a", "b")
    joined = kept(components(found), "joined")
    # a bucket of two lines has no others to compare
    told = members.where("n_lines > 1").join(joined, F.col("line") == F.col("node"), "left")
    told = told.select("key", "line", F.coalesce("root", "line").alias("root"), "place", "n_lines")
    rest = kept(open_pairs(told, marks).distinct(), "rest")
    again = similar_pairs(rest, distinct).where("same").select("a", "b")
    return joined.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(again)


def decisions(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, removed): for each document that loses lines, an array of structs (line, component).

    ``line`` counts from 0, ``component`` is the number of the line that stays in its place. A
    component keeps its first line by document and place; documents without an id come last.
    Empty lines are not compared and stay. Rows that share an id count as one document: of the
    same line at the same place all copies stay or all go.
    """
    each = docs.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(lines_of(F.col(f"`{text_col}`"))).alias("place", "text"))
    # a look at the raw line tells an empty one and keeps the filter from making every plain line twice
    each = each.where(F.col("text").rlike(r"[^\x00-\x20]")).select("id", "place", plain(F.col("text")).alias("words"))
    each = each.withColumn("line", F.xxhash64("words"))
    # copies meet before the shuffle; one text for each line remains
    distinct = bucketed(each.groupBy("line").agg(F.max("words").alias("words")), "line", "lines")
    joined = kept(components(links(distinct, band_keys(distinct))), "components")
    at = F.struct(F.col("id").isNull().alias("none"), "id", "place")
    spots = kept(each.select("id", "place", "line"), "spots")
    once = spots.groupBy("line").agg(F.min(at).alias("first"), F.count("*").alias("n"))
    # only lines with copies or links can go
    several = once.join(joined, once["line"] == joined["node"], "left").where("n > 1 OR root IS NOT NULL")
    several = kept(several.select("line", "first", F.coalesce("root", "line").alias("component")), "several")
    lowest = several.groupBy("component").agg(F.min("first").alias("lowest"))
    known = several.join(lowest, "component").select("line", "component", "lowest")
    gone = spots.join(known, "line").where(~at.eqNullSafe(F.col("lowest")))
    return gone.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(F.col("place").alias("line"), "component"))).alias("removed"))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The input's rows, with the texts that are left; a text of which nothing is left is empty, a null text stays null."""
    gone = decisions(docs, text_col, id_col).select(F.col("id").alias("__id"), F.transform("removed", lambda x: x["line"]).alias("__gone"))
    lines = lines_of(F.col(f"`{text_col}`"))
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    rows = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left")
    return rows.select(*[F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text_col else F.col(f"`{c}`")
                         for c in docs.columns])
