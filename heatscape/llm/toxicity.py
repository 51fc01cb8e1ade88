"""Toxicity of texts after deobfuscation by a noisy channel.

A token with digits or signs between letters, with runs of a letter, or spelled out letter by letter
becomes a lattice of the letters each character may stand for; the Viterbi path under a character
language model of the whole corpus restores it. A logistic model over words and pieces of words
scores the restored text.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import kept, release, slices, text_or_empty, with_columns
from heatscape.session import ship_package

# What a character may stand for besides itself, and the log-probability of each change.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SUBSTITUTED, DROPPED, REPEATED = math.log(0.05), math.log(0.1), math.log(0.2)
#: Letters of the language model: a-z, any other letter, and the end of a word.
OTHER, EDGE, SYMBOLS = 27, 0, 28
#: Characters of a window that is restored at once, and of the longest word: windows of a longer token share as many.
LONGEST, SHARED = 40, 20
TRIM = "!?.,;:*#%&$\"'()[]{}<>|-_~=+/\\^`"
SUSPECT = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]+[\d_]|[\d_@$][^\W\d_]|([^\W\d_])\1\1")
STRETCHED = re.compile(r"(.)\1{2,}", re.S)
SIGNS = re.compile(r"[^\w@$!|+€£¡]+|_+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
PIECE = 5
BUCKETS = 1 << 20
#: Bounds of the model: labelled rows it is fitted on, by hash order, and its features.
FIT_ROWS, FEATURES = 8_000, 3_000
LEAST_ROWS = 4
TEXT_LIMIT = 2_000_000


def _codes(text: str) -> np.ndarray:
    """Symbols of a text in lower case."""
    raw = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = (raw >= 97) & (raw <= 122)
    return np.where(letter, raw - 96, np.where(raw >= 0xAA, OTHER, EDGE)).astype(np.int32)


def language_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all symbol triples over the whole corpus, SYMBOLS ** 3 numbers at most."""
    ship_package(docs.sparkSession)

    def run(batches):
        release()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, TEXT_LIMIT):
                c = _codes("  ".join(["", *texts[a:b], ""]))
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    rows = (docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "code bigint, n bigint")
            .groupBy("code").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of the third symbol of a triple, smoothed by that of the second alone."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    pair = n.sum(axis=0)
    lower = (pair + 0.1) / (pair + 0.1).sum(axis=1, keepdims=True)
    return np.log((n + 5 * lower[None]) / (n.sum(axis=2, keepdims=True) + 5))


def restore(token: str, model: list) -> str:
    """The letters of a token on the best path; ``model`` is ``log_model`` as nested lists."""
    runs = [(m.group(1), len(m.group(0))) for m in re.finditer(r"(.)\1*", token.lower())]
    # a state is the last two symbols; it keeps its score and the letters so far
    states = {(EDGE, EDGE): (0.0, "")}
    for c, times in runs:
        choices = []
        if c.isalpha():
            choices = [(c * times, 0.0)] if times < 3 else [(c * 2, REPEATED), (c, REPEATED)]
        for x in LEET.get(c, ""):
            choices += [(x, SUBSTITUTED)] if times == 1 else [(x * 2, 2 * SUBSTITUTED), (x, SUBSTITUTED + REPEATED)]
        if not choices:  # a sign that stands for no letter
            choices = [("", DROPPED)]
        after: dict = {}
        for (p, q), (score, letters) in states.items():
            for x, cost in choices:
                a, b, s = p, q, score + cost
                for ch in x:
                    k = ord(ch) - 96 if "a" <= ch <= "z" else OTHER
                    s += model[a][b][k]
                    a, b = b, k
                if (a, b) not in after or after[a, b][0] < s:
                    after[a, b] = (s, letters + x)
        states = after
    best = max(((score + model[p][q][EDGE], letters) for (p, q), (score, letters) in states.items()), default=(0.0, ""))
    return best[1] or token


def windows(text: str | list) -> list:
    """Overlapping parts of at most LONGEST characters, so that any word of up to SHARED ones is whole in one of them."""
    return [text[k : k + LONGEST] for k in range(0, max(1, len(text) - SHARED), LONGEST - SHARED)]


class Restorer:
    """Words of tokens under a language model; remembers the latest tokens, and those before them."""

    def __init__(self, language: np.ndarray, kept_tokens: int = 300_000):
        release()  # words that the worker remembers for an operator before
        self.model, self.limit, self.known, self.older = language.tolist(), kept_tokens, {}, {}

    def word(self, token: str) -> str:
        """The words of a token, with spaces between those of one that is longer than any word."""
        core = token.strip(TRIM).lower()
        if len(core) <= LONGEST:
            return restore(core, self.model) if core and SUSPECT.search(core) else core
        core = STRETCHED.sub(r"\1\1\1", core)  # three of a letter count as any more of them
        parts = [core] if len(core) <= LONGEST else [p for p in SIGNS.split(core) if p]
        return " ".join(dict.fromkeys(restore(w, self.model) if SUSPECT.search(w) else w for p in parts for w in windows(p)))

    def words(self, text: str) -> set[str]:
        """Distinct words of the restored text, with those that were spelled out letter by letter."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        tokens = text.split()
        different = set(tokens)
        out = set(map(self.known.get, different))
        if None in out:
            out.discard(None)
            for t in different:
                if t not in self.known:
                    word = self.older.get(t)
                    self.known[t] = word = self.word(t) if word is None else word
                    out.add(word)
        for m in SPELLED.finditer(text):
            # words may follow each other letter by letter
            single = [c for c in m.group(0).split() if c.isalpha() or c in LEET]
            out.update(restore("".join(part), self.model) for part in windows(single))
        long = [w for w in out if " " in w]
        out.difference_update(long)
        out.update(p for w in long for p in w.split(" "))
        out.discard("")
        return out


def pieces(word: str) -> list[int]:
    """Numbers of a word and of its parts of five bytes."""
    edged = f"<{word}>".encode()
    crc = zlib.crc32
    return [crc(edged) % BUCKETS, *[crc(edged[k : k + PIECE]) % BUCKETS for k in range(len(edged) - PIECE + 1)]]


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 3.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression by coordinate-scaled gradient steps with momentum."""
    n, k = x.shape
    w, b, step = np.zeros(k), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(k)
    scale = 0.25 * x.sum(axis=0) + l2
    rate = 4.0 / max(4.0, float(np.median(x.sum(axis=1))))
    for _ in range(rounds * 10):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        g = x.T @ (p - y).astype(np.float32) + l2 * w
        step = 0.9 * step - rate * g / scale
        w += step
        b -= 0.5 * float((p - y).mean())
    return w, b


class Model:
    def __init__(self, language: np.ndarray, weights: dict[int, float], bias: float):
        self.language, self.weights, self.bias = language, weights, bias

    def score(self, words: set[str], known: dict) -> float:
        """``known`` remembers the features of words."""
        hit = set()
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) > 400_000:
                    known.clear()
                f = known[w] = tuple([k for k in pieces(w) if k in self.weights])
            if f:
                hit.update(f)
        z = self.bias + sum(self.weights[k] for k in sorted(hit))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """The language model of all ``docs`` and a classifier of their labelled rows.

    Labels of rows whose crc32(id as text) mod 4 is 2 are not used. A row with several labels
    counts as toxic if one of them is 1; null labels and ids are left out. At most FIT_ROWS
    rows are taken, by hash order.
    """
    language = log_model(language_counts(docs, text_col))
    given = docs.sparkSession.sparkContext.broadcast(language)
    key = F.col(f"`{id_col}`")
    marked = (labels.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull() & (F.crc32(key.cast("string")) % 4 != 2))
              .groupBy(key.alias("id")).agg(F.max((F.col(f"`{label_col}`") == 1).cast("int")).alias("label")))
    chosen = kept(marked.join(docs.select(key.alias("id")).distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS), "labelled")
    sample = docs.select(key.alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        own = Restorer(given.value)
        for batch in batches:
            rows = [sorted({k for w in own.words(t) for k in pieces(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.int32()))], names=["id", "label", "f"])

    rows = sample.mapInArrow(run, "id bigint, label int, f array<int>")
    found = rows.orderBy("id", "f").toArrow()
    y = found["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(language, {}, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else -3.0)
    lists = found["f"].combine_chunks()
    flat = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    df = np.bincount(flat, minlength=BUCKETS)
    bad = np.bincount(flat[(y > 0)[row]], minlength=BUCKETS)
    expected = df * y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.where(df >= min(LEAST_ROWS, max(2, len(y) // 100)), (bad - expected) ** 2 / (expected + 1), 0)
    top = np.argsort(-power, kind="stable")[:FEATURES]
    top = top[power[top] > 0]
    place = np.full(BUCKETS, -1, np.int32)
    place[top] = np.arange(len(top))
    keep = place[flat] >= 0
    x = np.zeros((len(y), len(top)), np.float32)
    x[row[keep], place[flat[keep]]] = 1
    w, b = _fit(x, y)
    return Model(language, {int(k): float(v) for k, v in zip(top, w, strict=True)}, b)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, score): the input's rows and how likely each is toxic; null texts count as empty, which get the score of a text without features."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = given.value
        restorer, words = Restorer(own.language), {}
        return lambda texts: [[own.score(restorer.words(t), words) for t in texts]]

    return with_columns(docs, text_col, "score double", make)
