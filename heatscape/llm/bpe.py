"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each task.

Words of a text are the matches of the tokenizer's pattern. Each word starts as its bytes; a
recursive query lays out token-position rows, joins each with its right neighbour to the merge
table and contracts the leftmost pair of the lowest rank of each word until no pair is left.
Decoding joins ids with the vocabulary and puts the bytes together by an ordered aggregation; the
database has one thread, so the aggregate reads the sorted rows in their order.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import held, with_columns

#: Words of at most so many bytes contract one pair a step, longer ones all pairs that can't affect each other.
SHORT = 48
#: Position rows of one recursive query, token rows of one decoding query.
ROWS = 200_000
TOKEN_ROWS = 300_000
#: Characters of the texts that a task has in parts, ids and bytes at once.
TEXT_CHARS = 2_000_000
#: Words, and parts of texts, whose ids a worker remembers; beyond that it starts anew.
CACHED_WORDS, CACHED_PIECES = 400_000, 200_000

CONTRACT = """
WITH RECURSIVE step(w, ts, i) AS (
  SELECT w, ts, 0 FROM word_lists
  UNION ALL
  SELECT step.w, step.ts[:p - 1] || [m] || step.ts[p + 2:], i + 1
  FROM step JOIN (
    SELECT pair.w, arg_min(pair.p, merges.m * 65536 + pair.p)::INT AS p, min(merges.m)::INT AS m
    FROM (SELECT w, unnest(ts[:-2]) AS l, unnest(ts[2:]) AS r, unnest(range(1, len(ts))) AS p
          FROM step WHERE len(ts) > 1) AS pair
    JOIN merges ON merges.l = pair.l AND merges.r = pair.r GROUP BY pair.w) AS best ON step.w = best.w
)
SELECT w, arg_max(ts, i) AS ts FROM step GROUP BY w ORDER BY w
"""

# One step for long words. All pairs of the lowest rank contract, alternate ones of a chain of equal
# tokens, up to the first contraction that would bring forth a pair of a lower rank still.
CONTRACT_LONG = """
WITH pair AS (
  SELECT w, row_number() OVER o AS p, t, lead(t) OVER o AS nt, lead(t, 2) OVER o AS nnt, lag(t) OVER o AS pt
  FROM long_rows WINDOW o AS (PARTITION BY w ORDER BY p)),
ranked AS (
  SELECT pair.*, merges.m, min(merges.m) OVER (PARTITION BY pair.w) AS low
  FROM pair LEFT JOIN merges ON merges.l = pair.t AND merges.r = pair.nt),
hits AS (SELECT w, p, p - row_number() OVER (PARTITION BY w ORDER BY p) AS chain FROM ranked WHERE m = low),
chosen AS (
  SELECT w, p FROM (SELECT w, p, row_number() OVER (PARTITION BY w, chain ORDER BY p) AS k FROM hits) WHERE k % 2 = 1),
marked AS (
  SELECT ranked.*, chosen.p IS NOT NULL AS c, lag(chosen.p, 2) OVER (PARTITION BY ranked.w ORDER BY ranked.p) AS c2
  FROM ranked LEFT JOIN chosen ON ranked.w = chosen.w AND ranked.p = chosen.p),
risky AS (
  SELECT k.w, min(k.p) AS stop
  FROM marked AS k
  LEFT JOIN merges AS a ON a.l = CASE WHEN k.c2 IS NULL THEN k.pt ELSE k.low END AND a.r = k.low
  LEFT JOIN merges AS b ON b.l = k.low AND b.r = k.nnt
  WHERE k.c AND (a.m < k.low OR b.m < k.low) GROUP BY k.w),
done AS (
  SELECT k.w, k.p, CASE WHEN k.c AND k.p <= coalesce(r.stop, k.p) THEN k.low ELSE k.t END AS t,
         k.c AND k.p <= coalesce(r.stop, k.p) AS joined
  FROM marked AS k LEFT JOIN risky AS r ON k.w = r.w)
SELECT w, p, t FROM (SELECT *, lag(joined) OVER (PARTITION BY w ORDER BY p) AS eaten FROM done)
WHERE eaten IS NOT TRUE
"""

DECODE = """
SELECT d, string_agg(x, '') AS x
FROM (SELECT tokens.d, vocabulary.x FROM tokens JOIN vocabulary ON tokens.t = vocabulary.t ORDER BY tokens.d, tokens.p)
GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """A merge table, a vocabulary and a private in-memory database of one Python worker."""

    def __init__(self, ranks_path: str):
        import duckdb
        import numpy as np

        self.np, ranks = np, read_ranks(ranks_path)
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        rows = [(ranks[t[:k]], ranks[t[k:]], m) for t, m in ranks.items() for k in range(1, len(t))
                if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        l, r, m = (np.array(c, np.int32) for c in zip(*rows, strict=True))
        merges = pa.table({"l": l, "r": r, "m": m.astype(np.int64)})
        vocabulary = pa.table({"t": np.array(list(ranks.values()), np.int32), "x": [t.hex() for t in ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as int32 bytes."""
        np, db = self.np, self.db
        sizes = np.array([len(w) for w in words])
        first = self.start[np.frombuffer(b"".join(words), np.uint8)]
        if len(words[-1]) <= SHORT:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(first))
            db.register("word_lists", pa.table({"w": np.arange(len(words), dtype=np.int32), "ts": lists}))
            found = db.sql(CONTRACT).to_arrow_table()["ts"].combine_chunks()
            db.unregister("word_lists")
            ids, ends = found.values.to_numpy(), found.offsets.to_numpy()
            return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        db.register("given", pa.table({"w": w, "p": p, "t": first}))
        db.execute("CREATE OR REPLACE TABLE long_rows AS SELECT * FROM given")
        db.unregister("given")
        before = -1
        while (now := db.execute("SELECT count(*) FROM long_rows").fetchone()[0]) != before:
            before = now
            db.execute(f"CREATE OR REPLACE TABLE next_rows AS {CONTRACT_LONG}")
            db.execute("CREATE OR REPLACE TABLE long_rows AS SELECT * FROM next_rows")
        out = db.execute("SELECT w, t FROM long_rows ORDER BY w, p").fetchnumpy()
        ids = np.ascontiguousarray(out["t"], np.int32)
        ends = np.searchsorted(out["w"], np.arange(len(words)), side="right")
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Words in the order of their size, so that one query holds words of like size."""
        raw = [w.encode() for w in words]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        out: list[bytes] = [b""] * len(raw)
        at = 0
        while at < len(order):
            end, size = at, 0
            while end < len(order) and (end == at or size + len(raw[order[end]]) <= ROWS
                                        and (len(raw[order[end]]) <= SHORT) == (len(raw[order[at]]) <= SHORT)):
                size += len(raw[order[end]])
                end += 1
            for i, ids in zip(order[at:end], self._contracted([raw[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def encode(self, texts: list[str], pattern) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        get, found, missing = self.pieces.get, [], set()
        for t in texts:
            parts = _parts(t)
            ids = None if parts is None else list(map(get, parts))
            if ids is not None and None in ids:
                missing.update([x for x, y in zip(parts, ids, strict=True) if y is None])
                ids = parts
            found.append(ids)
        whole = [pattern.findall(t) if f is None else None for t, f in zip(texts, found, strict=True)]
        new = list(missing)
        matches = [pattern.findall(x[1:] if x[0] == "\n" else " " + x) if x else [" "] for x in new]
        words = [w for w in {w for m in (*matches, *filter(None, whole)) for w in m} if w not in self.words]
        self.words.update(zip(words, self.encode_words(words), strict=True))
        known = self.words.__getitem__
        self.pieces.update((x, b"".join(map(known, m))) for x, m in zip(new, matches, strict=True))
        made = []
        for f, w in zip(found, whole, strict=True):
            if w is not None:
                made.append(b"".join(map(known, w)))
            else:
                made.append(b"".join(f if not f or isinstance(f[0], bytes) else map(self.pieces.__getitem__, f)))
        return made

    def decode(self, docs: list) -> list[bytes]:
        """Bytes of each list of ids; an id outside the vocabulary adds none."""
        np, out, at = self.np, [b""] * len(docs), 0
        while at < len(docs):
            end, size = at, 0
            while end < len(docs) and (end == at or size + len(docs[end]) <= TOKEN_ROWS):
                size += len(docs[end])
                end += 1
            sizes = [len(d) for d in docs[at:end]]
            table = pa.table({"d": np.repeat(np.arange(at, end, dtype=np.int32), sizes), "p": np.arange(size, dtype=np.int32),
                              "t": np.concatenate([np.asarray(d, np.int32) for d in docs[at:end]])})
            self.db.register("tokens", table)
            for d, x in self.db.execute(DECODE).fetchall():
                out[d] = bytes.fromhex(x or "")
            self.db.unregister("tokens")
            at = end
        return out


def _parts(text: str) -> list[str] | None:
    """Parts of a text that the pattern splits alike on their own, None if there are none.

    Where two white-space characters never meet, every space starts a part. The space is not
    part of the key; a first part, which has none, is marked by a line feed, with which no other starts.
    """
    if DOUBLE.search(text):
        return None
    first, *rest = text.split(" ")
    return ["\n" + first, *rest] if first else rest


DOUBLE = re.compile(r"\s\s")


def compiled_pattern(pattern: str):
    r"""The pattern with ``\s`` as Unicode's white space, as the tokenizer's own engine has it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def codec(path: str) -> Codec:
    """The worker's codec of a rank file; later tasks of the worker use it again."""
    return held(("bpe", path), lambda: Codec(path))


def _lists(parts: list[bytes]) -> pa.Array:
    import numpy as np

    ends = np.cumsum([0, *[len(p) // 4 for p in parts]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(row, ids): the input's rows and the ids of their texts. Null and empty texts have no ids."""

    def make():
        compiled, own = compiled_pattern(pattern), codec(ranks_path)
        return lambda texts: [_lists(own.encode(texts, compiled))]

    return with_columns(docs, text_col, "ids array<int>", make, TEXT_CHARS)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """(row, ids, decoded): also the bytes that the ids decode to; ``row`` has all columns, or those of ``columns``.

    Null and empty texts give no ids and no bytes; repeated rows are encoded each for itself.
    """

    def make():
        import numpy as np

        compiled, own = compiled_pattern(pattern), codec(ranks_path)

        def columns(texts):
            ids = own.encode(texts, compiled)
            decoded = own.decode([np.frombuffer(x, np.int32) for x in ids])
            return [_lists(ids), pa.array(decoded, pa.binary())]
        return columns

    return with_columns(docs, text_col, "ids array<int>, decoded binary", make, TEXT_CHARS, columns)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the bytes of its ids (null ids: none)."""
    from pyspark.sql import types as T

    wide = encoded.select(F.struct(*encoded.columns).alias("row"), F.coalesce(F.col(ids_col), F.expr("array()")).cast("array<int>").alias("ids"))

    def run(batches):
        own = codec(ranks_path)
        for batch in batches:
            ids = [x.values.to_numpy() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(ids), pa.binary())], names=["row", "decoded"])

    return wide.mapInArrow(run, T.StructType([wide.schema["row"], T.StructField("decoded", T.BinaryType())]))
