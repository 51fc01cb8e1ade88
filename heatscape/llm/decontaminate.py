"""Benchmark passages in documents, by an FM-index of word symbols over every shard of documents.

A shard is a run of documents in a task. Its words become symbols; words that no benchmark item
has are gaps, and stretches shorter than the shortest window can't hold one and are left out. The
shard's Burrows-Wheeler transform is kept as a wavelet matrix; windows are searched backward
through its ranks, all of them at once, and places come from sampled suffix positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import kept, with_columns, words_of

WINDOW = 13
#: Symbols of one index, one document at least; a symbol takes about 4 bytes for each bit of the alphabet.
SHARD_SYMBOLS = 1_000_000
#: Bytes of benchmark text that are broadcast at a time; a larger benchmark takes a pass a block.
BLOCK_BYTES = 16_000_000
SAMPLE_EVERY = 8


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; the first sort takes as many symbols as fit in 62 bits."""
    n = len(codes)
    bits = max(1, int(codes.max() + 1).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([codes + 1, np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + after
        h *= 2


class FMIndex:
    """Index of ``symbols``, in which 0 is a gap that matches nothing; the last symbol must be a gap."""

    def __init__(self, symbols: np.ndarray, top: int):
        n = len(symbols)
        gap = symbols == 0
        n_gaps = int(gap.sum())
        # gaps differ from each other, so ties are no longer than a stretch
        sa = suffix_order(np.where(gap, np.cumsum(gap) - 1, symbols + n_gaps - 1))
        bwt = symbols[sa - 1]
        self.n = n
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.cumsum(counts) - counts  # row of the first suffix that starts with a symbol
        self.levels, x = [], bwt
        for b in reversed(range(max(1, int(top).bit_length()))):
            one = (x >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32)
            self.levels.append((b, zeros, int(zeros[-1])))
            x = np.concatenate([x[one == 0], x[one == 1]])
        self.begin = np.zeros(top + 1, np.int64)
        self.begin = self._down(np.arange(top + 1), self.begin)
        stretch_start = np.concatenate([[True], gap[:-1]])
        sampled = (sa % SAMPLE_EVERY == 0) | stretch_start[sa]
        self.sampled, self.position = sampled, np.where(sampled, sa, -1)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, zeros, z in self.levels:
            i = np.where((c >> b) & 1, z + i - zeros[i], zeros[i])
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c in the first i rows of the transform."""
        return self._down(c, i) - self.begin[c]

    def back(self, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that start one place before."""
        c = np.zeros(len(i), np.int64)
        for b, zeros, z in self.levels:
            one = 1 - (zeros[i + 1] - zeros[i])
            c |= one.astype(np.int64) << b
            i = np.where(one, z + i - zeros[i], zeros[i])
        return self.first[c] + i - self.begin[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase numbers, first row, row behind the last) of phrases of one length that occur."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[which, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            on = hi > lo
            which, lo, hi = which[on], lo[on], hi[on]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, steps, open_ = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(open_ := open_[~self.sampled[at[open_]]]):
            at[open_] = self.back(at[open_])
            steps[open_] += 1
        return self.position[at] + steps


class Phrases:
    """Distinct windows of a block of benchmark items, by length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1) if ids else ():
                found.setdefault(tuple(ids[k : k + size]), set()).update([] if item is None else [item])
        lengths = sorted({len(p) for p in found})
        self.shortest = lengths[0] if lengths else 0
        self.by_length = [(np.array([p for p in found if len(p) == size], np.int64),
                           [sorted(s) for p, s in found.items() if len(p) == size]) for size in lengths]

    def hits(self, docs: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document, given as symbols with 0 for unknown words: merged spans of words, and items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set] = [set() for _ in docs]
        sizes = np.array([len(d) + 1 for d in docs])
        begins = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int64)
        for b, d in zip(begins, docs, strict=True):
            flat[b : b + len(d)] = d
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (flat > 0).astype(np.int8), [0]])))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= max(1, self.shortest)
        starts, ends = starts[keep], ends[keep]
        if not len(starts) or not self.by_length:
            return spans, items
        # every stretch with one gap behind it
        length = ends - starts + 1
        place = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        symbols = np.where(flat[place] > 0, flat[place], 0)
        index = FMIndex(symbols, len(self.vocabulary))
        doc_at = np.searchsorted(begins, place, side="right") - 1
        change = np.zeros(len(symbols) + 1, np.int32)
        for phrases, owners in self.by_length:
            which, lo, hi = index.search(phrases)
            if not len(which):
                continue
            many = hi - lo
            rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            at = index.locate(rows)
            np.add.at(change, at, 1)
            np.add.at(change, at + phrases.shape[1], -1)
            pairs = np.unique(doc_at[at] * len(phrases) + np.repeat(which, many))
            for pair in pairs.tolist():
                items[pair // len(phrases)].update(owners[pair % len(phrases)])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            d = int(doc_at[a])
            spans[d].append((int(place[a] - begins[d]), int(place[b - 1] - begins[d]) + 1))
        return spans, items


def merged(a: list, b: list) -> list:
    out: list = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FIELDS = "n_words bigint, spans array<struct<first: bigint, behind: bigint>>, items array<string>"


def _pass(docs: DataFrame, items: list, text_col: str, window: int) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        phrases = Phrases(given.value, window)
        get = phrases.vocabulary.get

        def columns(texts):
            n_words, spans, items, shard, size = [], [], [], [], 0

            def close():
                s, i = phrases.hits(shard)
                spans.extend(s)
                items.extend([sorted(x) for x in i])
                shard.clear()

            for t in texts:
                words = words_of(t)
                n_words.append(len(words))
                shard.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
                size += len(words)
                if size >= SHARD_SYMBOLS:
                    close()
                    size = 0
            close()
            return [n_words, [[{"first": a, "behind": b} for a, b in s] for s in spans], items]
        return columns

    return with_columns(docs, text_col, FIELDS, make)


def find_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, n_words, spans, items): the input's rows, their number of words, the merged spans of
    words inside benchmark windows, and the items that have such windows.

    A window is ``window`` consecutive words of an item; an item with fewer is one window. Null
    and empty texts have no words. An item without an id marks spans but is not listed; repeated
    items count once. The benchmark is broadcast in blocks of bounded size; where one block does
    not hold it, each further block adds to the rows that the one before has written.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= BLOCK_BYTES:
        return _pass(docs, [tuple(r) for r in items.collect()], text_col, window)
    blocks = -(-size // BLOCK_BYTES)
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.expr("cast(0 as bigint)").alias("n_words"), F.expr("cast(array() as array<struct<first: bigint, behind: bigint>>)").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("items"), F.col(f"row.`{text_col}`").alias("text"))
    for block in range(blocks):
        part = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).collect()]
        step = _pass(found, part, "text", window)
        found = kept(step.select("row.row", "n_words", _merged_spans(F.concat("row.spans", "spans")).alias("spans"),
                                 F.array_union("row.items", "items").alias("items"), "row.text"), "passages")
    return found.select("row", "n_words", "spans", F.array_sort("items").alias("items"))


def _merged_spans(spans: Column) -> Column:
    """Overlapping or touching spans as one."""
    kind = "array<struct<first: bigint, behind: bigint>>"
    return F.aggregate(F.array_sort(spans), F.expr(f"cast(array() as {kind})"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["behind"] >= s["first"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["first"].alias("first"),
            F.greatest(F.element_at(acc, -1)["behind"], s["behind"]).alias("behind"))))).otherwise(F.concat(acc, F.array(s))))


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["behind"] - s["first"])


def is_contaminated() -> Column:
    """A twentieth of the words at least is inside windows."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
