"""Periodic runs of words: stretches that repeat themselves at least ``times`` times.

Each word increments the match lengths of the lags at which its context stood before; a lag that is
not incremented any more has ended, and is a run if it was long enough. A word's context is the ``k``
words that end with it, and only the nearest earlier place of a context counts, one ``k`` for each
class of lags ``(k / 2, k]``. Both lose no run: inside a run of smallest period q in that class, k words
have stood q words before, and no nearer, because two periods in q + k words would make q's divisor a
period (Fine and Wilf). So a word has at most log2(n) lags, however often its words are repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import doc_column, with_columns

FIELDS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
#: Odd multipliers of a hash of contexts; it only tells texts without any repeated context.
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def shortest_match(least: int, times: int) -> int:
    """Words that match at the lag of any run, whatever its period."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _paired(ids: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the pairs of a place's number with that ``shift`` places on; equal pairs get equal numbers."""
    code = ids[:-shift] * (int(ids.max()) + 1) + ids[shift:]
    return np.unique(code, return_inverse=True)[1].astype(np.int64)


def _contexts(ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all stretches of ``k`` words, by their first word."""
    length = 1
    while length < k:
        step = min(length, k - length)
        ids, length = _paired(ids, step), length + step
    return ids


def _any_repeated(ids: np.ndarray, k: int) -> bool:
    """False only if no stretch of ``k`` words stands twice."""
    h, length, turn = ids.astype(np.uint64) * np.uint64(MIX[0]) ^ np.uint64(MIX[1]), 1, 0
    h ^= h >> np.uint64(29)
    while length < k:
        step = min(length, k - length)
        h = h[:-step] * np.uint64(MIX[turn % 4]) + h[step:]
        h ^= h >> np.uint64(31)
        length, turn = length + step, turn + 1
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _lags(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(end, lag, context length) of all words whose context stood before, by end; end is the place after the word."""
    k = shortest_match(least, times)
    low, longest, found = 0, len(ids) // times, []
    if len(ids) < least or not _any_repeated(ids, k):
        return []
    grams = _contexts(ids, k)
    while low < longest and len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        if not same.any():
            break
        place, lag = order[1:][same], (order[1:] - order[:-1])[same]
        inside = (lag > low) & (lag <= min(k, longest))
        found += zip((place[inside] + k).tolist(), lag[inside].tolist(), [k] * int(inside.sum()))
        if len(grams) <= k:
            break
        low, grams, k = k, _paired(grams, k), 2 * k
    return sorted(found)


def runs_of(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    A run has ``max(least, times * period)`` words at least, repeats its smallest period and can't be
    made longer on either side. ``times`` is 3 or more.
    """
    if times < 3 or least < 1:
        raise ValueError("runs repeat three times or more")
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    out, active, at = [], {}, -1

    def ended(lag: int, matched: int, end: int) -> None:
        if matched + lag >= max(least, times * lag):
            out.append((end - matched - lag, matched + lag, lag))

    for end, lag, k in _lags(ids, least, times):
        if end != at:  # a lag that the word before did not increment has ended
            for d in [d for d, (last, _) in active.items() if last < end - 1]:
                last, matched = active.pop(d)
                ended(d, matched, last)
            at = end
        active[lag] = (end, active[lag][1] + 1 if lag in active else k)
    for d, (last, matched) in active.items():
        ended(d, matched, last)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by a space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """(row, n_words, runs, collapsed): the input's rows with the periodic runs of their words.

    Words are what stands between ASCII white space. Null and empty texts have no words, no runs and an
    empty collapsed text. Rows are taken one by one, so repeated rows get the same result each. A text of
    n words takes n log n steps and some hundred bytes a word, whatever it repeats; nothing is cut.
    Runs of different periods may overlap and are all returned. Other columns stay inside ``row``.
    """
    def make():
        def columns(texts):
            n, runs, texts_out = [], [], []
            for t in texts:
                words = t.encode("utf-8", "surrogatepass").split()
                found = runs_of(words, least, times)
                n.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                texts_out.append(collapsed(words, found).decode("utf-8", "surrogatepass"))
            return [n, runs, pa.array(texts_out, pa.string())]
        return columns

    return with_columns(docs, text_col, FIELDS, make)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a run of a third to a tenth of the words left from a place on in every tenth text by its id's hash.

    Both are taken from crc32 of the decimal id. Rows without id or words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("bigint")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
    changed = F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col(text_col))
    return docs.withColumn(text_col, F.when(h % 10 == 0, changed).otherwise(F.col(text_col)))


def _strongest() -> Column:
    """The run of the greatest length / period, compared exactly; ties go to the smallest start, then period."""
    def better(best, r):
        left, right = r["length"] * best["period"], best["length"] * r["period"]
        first = (r["start"] < best["start"]) | ((r["start"] == best["start"]) & (r["period"] < best["period"]))
        return F.when((left > right) | ((left == right) & first), r).otherwise(best)
    return F.when(F.size("runs") > 0, F.aggregate("runs", F.col("runs")[0], better))


def digest_columns(found: DataFrame) -> DataFrame:
    """One row a document: count, strongest run and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", _strongest())
    return best.select(
        doc_column(), F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
