"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds one frame for each document, its ids as little-endian unsigned 32-bit integers, then a
directory frame with the documents' ids and sizes, and ends with a skippable frame in the published
seekable format of zstandard: compressed size, size and low half of the XXH64 of every frame, and a
footer. A reader takes the footer, the table and the directory, and then only the frames it wants.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import held, kept, slices, text_or_empty
from heatscape.session import scratch_folder, ship_package

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
LEVEL = 3
#: Parts of texts whose ids a worker remembers, twice: the latest, and those before them.
CACHED = 500_000
#: Parts that are encoded together, and in one text if they are plain.
TOGETHER = 20_000
JOINED = 1_000
#: Steps of a tokenizer before its model that change a plain part only to lower case, and their split in lower case.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
NO_ID = -(1 << 63)


def checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(data) & 0xFFFFFFFF


class Writer:
    def __init__(self, out):
        import zstandard

        self.out, self.pack, self.table, self.entries = out, zstandard.ZstdCompressor(level=LEVEL), [], []

    def _frame(self, data: bytes) -> None:
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(data), checksum(data)))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._frame(ids)
        self.entries.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))

    def close(self) -> None:
        self._frame(np.array(self.entries, "<i8").tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class Reader:
    """Reads the tail of an open file at first, then the frames asked for."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        if struct.unpack("<II", self._read(size - 17 - 12 * n, 8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.table, ends = table, np.cumsum(table[:, 0].astype(np.int64))
        self.begins = ends - table[:, 0]
        directory = np.frombuffer(self.frame(n - 1), "<i8").reshape(-1, 2)
        self.doc_ids, self.sizes = directory[:, 0], directory[:, 1]

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, told = (int(x) for x in self.table[k])
        data = self.unpack.decompress(self._read(int(self.begins[k]), packed), max_output_size=size)
        if len(data) != size or checksum(data) != told:
            raise ValueError(f"frame {k} is damaged")
        return data

    def __len__(self) -> int:
        return len(self.doc_ids)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of that number; decompresses no other."""
        a, b = np.searchsorted(self.doc_ids, doc_id), np.searchsorted(self.doc_ids, doc_id, side="right")
        return [np.frombuffer(self.frame(k), "<u4") for k in range(a, b)]


def _store(folder: str):
    """File system and path of a folder; local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


class Encoder:
    """Ids of texts by the tokenizers library.

    The tokenizer drops white space and looks at nothing across it, so the parts of a text between
    spaces and line feeds are encoded each for itself, and a part met before is not encoded again.
    New plain parts (printable ASCII and Latin letters, nothing like an added token) are put into lower
    case and split at words here; words that are new go through the model many in a text, and a token
    that ends a word tells where the next one starts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.parts, self.older, self.model = Tokenizer.from_file(path), {}, {}, None
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        suffix = given["model"].get("end_of_word_suffix")
        added = [a["content"] for a in given["added_tokens"]]
        if suffix and all(given[k] == v for k, v in STEPS.items()) and all(a.startswith("<|") for a in added):
            split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, STEPS["pre_tokenizer"]["pretokenizers"][1]]}
            self.model = Tokenizer.from_str(json.dumps({**given, "normalizer": None, "pre_tokenizer": split}))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _each(self, some: list[str]) -> list[bytes]:
        """Ids of each part, encoded for itself."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in ids]) * 4
        flat = np.array([i for x in ids for i in x], "<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of each word of plain parts, encoded in one text."""
        ids = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends, flat = (np.flatnonzero(self.ends[ids]) + 1) * 4, ids.tobytes()
        if len(ends) != len(words):
            return self._each(words)
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _taken(self, some: list[str]) -> list[str]:
        """Those of ``some`` that are not among the older parts; the others are taken over."""
        if not self.older:
            return some
        ids = list(map(self.older.get, some))
        self.parts.update((x, y) for x, y in zip(some, ids, strict=True) if y is not None)
        return [x for x, y in zip(some, ids, strict=True) if y is None]

    def _add(self, some: list[str], size: int, ids_of) -> None:
        for k in range(0, len(some), size):
            self.parts.update(zip(some[k : k + size], ids_of(some[k : k + size]), strict=True))

    def _learn(self, new: list[str]) -> None:
        unknown, single, mixed = self._taken(new), [], []
        if self.model is not None:
            single = [x for x in unknown if x.isalpha() and (x.isascii() or PLAIN.fullmatch(x))]
            mixed = [x for x in set(unknown).difference(single) if PLAIN.fullmatch(x) and "<|" not in x]
        self._add(list(set(unknown).difference(single, mixed)), TOGETHER, self._each)
        # parts with signs and capitals have most of their words in common
        lower, words = list(map(str.lower, single)), [WORD.findall(x.lower()) for x in mixed]
        self._add(self._taken(list(set(lower).union(*words).difference(self.parts))), JOINED, self._joined)
        known = self.parts.__getitem__
        self.parts.update(zip(single, map(known, lower), strict=True))
        self.parts.update((x, b"".join(map(known, w))) for x, w in zip(mixed, words, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; its parts are numbered, so that each distinct one is looked up once for all texts."""
        if len(self.parts) > CACHED:  # parts that are met again are taken over from the older half
            self.parts, self.older = {}, self.parts
        found = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        numbered = found.flatten().dictionary_encode()
        distinct, at = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), numbered.indices.to_numpy()
        ids = list(map(self.parts.get, distinct))
        if None in ids:
            self._learn([x for x, y in zip(distinct, ids, strict=True) if y is None])
            ids = list(map(self.parts.__getitem__, distinct))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begins, n = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(n)
        whole = flat[np.repeat(begins[at] - (ends - n), n) + np.arange(n.sum())].tobytes()
        bounds = (np.concatenate([[0], ends])[found.offsets.to_numpy()] * 4).tolist()
        return [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; later tasks of the worker use it again."""
    return held(("tokens", path), lambda: Encoder(path))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write token files into ``folder`` and return (part, path, n_docs, n_ids), one row for each file.

    Documents are in ascending order of their id over files and within them (no id: first; equal
    ids: by text), each with ``end_id`` behind its ids; null and empty texts have that id alone. A
    file appears under its name only when it is whole, so a task that is run again does no harm.
    """
    ship_package(docs.sparkSession)
    ordered = (docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def run(batches):
        import os
        import uuid

        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        part, n_docs, n_ids, writer, out = TaskContext.get().partitionId(), 0, 0, None, None
        store, root = _store(folder)
        end = struct.pack("<I", end_id)
        own = encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    attempt = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(attempt)
                    writer = Writer(out)
                for doc_id, ids in zip(doc_ids[a:b], own.encode(texts[a:b]), strict=True):
                    writer.add(doc_id, ids + end)
                    n_docs += 1
                    n_ids += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            path = f"{root}/tokens-{part:06d}.zst"
            store.move(attempt, path)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/tokens-{part:06d}.zst"], "n_docs": [n_docs], "n_ids": [n_ids]},
                                             schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return kept(ordered.mapInArrow(run, "part int, path string, n_docs bigint, n_ids bigint"), "manifest")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest.

    ``start`` counts the ids of all documents before it. The driver holds one number a file.
    """
    spark = files.sparkSession
    rows, at = [], 0
    for r in files.orderBy("part").toLocalIterator():
        rows.append((r["path"], at))
        at += r["n_ids"]
    listed = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, min(len(rows), 10_000)))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder, _, name = path.rpartition("/")
                store, root = _store(folder)
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    crc = [zlib.crc32(reader.frame(k)) for k in range(len(reader))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID), pa.array(start + np.cumsum(reader.sizes) - reader.sizes),
                         pa.array(reader.sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **names) -> DataFrame:
    """Both; files go to a new folder next to the checkpoints unless ``folder`` is given."""
    return read(write(docs, folder or f"{scratch_folder(docs.sparkSession)}/tokens", tokenizer, end_id, **names))
