"""Phrase collocations of each language by best-first branch-and-bound growth.

A phrase's score is 2,000,000 * a / (l + r) at its worst cut, with a, l, r the counts of the phrase and of
its two parts. No count of a phrase passes those of its parts, so the counts of a prefix (and of a suffix)
bound the score of whatever grows from it. Growth starts with the words, goes on with their pairs and then
takes only prefixes and suffixes whose bound reaches a language's threshold, which is set where many pairs
score as well or better. If ``top`` phrases survive above the threshold, the language is settled: nothing
left outside can score as well. If not, the threshold is lowered and the frontier behind it expanded, down to
zero.

Bounds travel to the tasks as tables of fixed size: a phrase's slot, by its hash, holds the least and the
greatest count of the phrases in it. A shared slot loosens a bound and never tightens it, so tables that are
too small cost work and change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatscape.llm.common import kept, slices, text_or_empty
from heatscape.session import ship_package

#: Lower-cases A-Z, turns the ends of pieces into line feeds and tabs into spaces.
PIECE_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
#: Slots of a table of bounds, and of the thresholds by language.
SLOTS, LANGUAGE_SLOTS = 1 << 21, 1 << 12
SCALE = 2_000_000
#: Characters that are numbered and counted at once.
TEXT_LIMIT = 4_000_000
#: Steps of the logarithm of the score in which thresholds are chosen; a threshold that no score reaches.
STEPS, CLOSED = 20, SCALE + 1
#: The first threshold leaves this many times ``top`` pairs above it; each further one, so many times more.
REACH, WIDER = 4, 8
MULTIPLIER, SEED = np.uint64(0x9E3779B97F4A7C15), 42
COUNTED = "lang string, phrase string, f bigint"


def _language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), SEED)


def _word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def _slot(hashes: list[np.ndarray], slots: int) -> np.ndarray:
    """Slots of phrases, given the hashes of their first words, second words and so on."""
    h = hashes[0]
    for more in hashes[1:]:
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + more
    return ((h ^ (h >> np.uint64(29))) * MULTIPLIER >> np.uint64(32)).astype(np.int64) % slots


class Bounds:
    """Least and greatest count of the phrases of each slot (greatest 0: none), and whether one of them is a candidate."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray):
        self.lo, self.hi, self.wanted = lo, hi, wanted

    @classmethod
    def of(cls, table: DataFrame, wanted: Column, slots: int) -> Bounds:
        """Of all rows (lang, phrase, f), phrases of one length; at most ``slots`` rows come to the driver."""
        def run(batches):
            for batch in batches:
                langs, phrases = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
                if not phrases:
                    continue
                seeds = {x: _language_seed(x) for x in set(langs)}
                digest = xxhash.xxh64_intdigest
                columns = [np.fromiter((digest(p[k], seeds[x]) for x, p in zip(langs, phrases, strict=True)), np.uint64, len(langs))
                           for k in range(len(phrases[0]))]
                yield pa.RecordBatch.from_arrays([pa.array(_slot(columns, slots), pa.int64()), batch.column(2), batch.column(3)], names=["slot", "f", "wanted"])

        rows = (table.select("lang", "phrase", "f", wanted.cast("boolean").alias("wanted"))
                .mapInArrow(run, "slot bigint, f bigint, wanted boolean").groupBy("slot")
                .agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.max("wanted").alias("wanted")).toArrow())
        lo, hi, marked = np.zeros(slots, np.float32), np.zeros(slots, np.float32), np.zeros(slots, bool)
        at = rows["slot"].to_numpy()
        # rounded outwards, so that they stay bounds
        lo[at] = np.nextafter(rows["lo"].to_numpy().astype(np.float32), np.float32(0))
        hi[at] = np.nextafter(rows["hi"].to_numpy().astype(np.float32), np.float32(np.inf))
        marked[at] = rows["wanted"].to_numpy(zero_copy_only=False)
        return cls(lo, hi, marked)


class Text:
    """Words of texts of one language, as numbers in order; 0 stands between pieces."""

    def __init__(self, texts: list[str], lang: str):
        number = {b"\n": 0}
        flat = []
        for piece in "\n".join(texts).encode().translate(PIECE_BYTES).split(b"\n"):
            flat += piece.split()
            flat.append(b"\n")
        put = number.setdefault
        self.ids = np.fromiter((put(w, len(number)) for w in flat), np.int64, len(flat))
        self.words, self.lang = list(number), lang

    def hashes(self) -> np.ndarray:
        return _word_hashes(self.words, _language_seed(self.lang))

    def counted(self, places: np.ndarray, length: int) -> tuple[list[str], np.ndarray]:
        """Distinct phrases of ``length`` words that start at ``places``, and how often they do."""
        key, n = self.ids[places], len(self.words)
        for k in range(1, length):
            if k > 1:  # numbers of the phrases so far, so that the product stays in 64 bits
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key * n + self.ids[places + k]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        columns = [self.ids[places[first] + k].tolist() for k in range(length)]
        w = self.words
        return [b" ".join([w[i] for i in phrase]).decode() for phrase in zip(*columns, strict=True)], times


class Growth:
    """Places of a text whose phrase of ``length`` words may matter, given the bounds of shorter phrases.

    A phrase matters if it can reach the threshold, if a longer one that grows from it to the right or
    to the left can, or if it can hold enough of the places of a candidate inside it to drop it.
    """

    def __init__(self, length: int, longest: int, least: int, share: float, levels: list[Bounds], thresholds: np.ndarray):
        self.length, self.longest, self.least, self.share, self.levels, self.thresholds = length, longest, least, share, levels, thresholds

    def places(self, text: Text) -> np.ndarray:
        threshold = self.thresholds[_language_seed(text.lang) % LANGUAGE_SLOTS]
        size = len(text.ids) - self.length + 1
        if threshold >= CLOSED or size <= 0:
            return np.zeros(0, np.int64)
        h, words = text.hashes(), self.levels[0]
        slot = _slot([h], len(words.hi))
        slot[0] = -1
        usual = words.hi[slot] >= self.least
        usual[0] = False
        known = [np.where(usual, slot, -1)[text.ids]]  # by length, the slot of the phrase that starts at each place, or -1
        for m in range(2, self.length):
            both = np.flatnonzero((known[-1][:-1] >= 0) & (known[-1][1:] >= 0))
            at = _slot([h[text.ids[both + k]] for k in range(m)], len(words.hi))
            at[self.levels[m - 1].hi[at] < self.least] = -1
            row = np.full(len(known[-1]) - 1, -1, np.int64)
            row[both] = at
            known.append(row)
        p = np.flatnonzero((known[-1][:-1] >= 0) & (known[-1][1:] >= 0))
        if self.length == 2:
            return p
        m, whole = self.length, self.levels[-1]
        front, back = known[-1][p], known[-1][p + 1]
        most = np.minimum(whole.hi[front], whole.hi[back]).astype(float)
        left = [self.levels[k - 1].lo[known[k - 1][p]].astype(float) for k in range(1, m)]
        right = [self.levels[m - k - 1].lo[known[m - k - 1][p + k]].astype(float) for k in range(1, m)]
        reach = threshold * (1 - 1e-9) / SCALE
        own = np.min([most / (x + y) for x, y in zip(left, right, strict=True)], axis=0)
        keep = own >= reach
        if m < self.longest:
            keep |= np.min([most / (x + most) for x in left], axis=0) >= reach
            keep |= np.min([most / (most + y) for y in right], axis=0) >= reach
        share = self.share * (1 - 1e-6)
        keep |= whole.wanted[front] & (most >= share * whole.lo[front])
        keep |= whole.wanted[back] & (most >= share * whole.lo[back])
        if m == 3:
            return p[keep]
        # a candidate may also be dropped by a phrase whose other end has not grown: that end's pair bounds its count
        ends, pairs = known[-1], self.levels[1]
        one = np.flatnonzero(((ends[:-1] >= 0) != (ends[1:] >= 0)) & (known[1][:-2] >= 0) & (known[1][2:] >= 0))
        grown = np.maximum(ends[one], ends[one + 1])
        pair = np.where(ends[one] >= 0, known[1][one + 2], known[1][one])
        one = one[whole.wanted[grown] & (pairs.hi[pair] >= share * whole.lo[grown])]
        return np.sort(np.concatenate([p[keep], one]))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Text]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts, TEXT_LIMIT):
            by: dict[str, list] = {}
            for lang, t in zip(langs[a:b], texts[a:b], strict=True):
                by.setdefault(lang, []).append(t)
            for lang, some in by.items():
                yield Text(some, lang)


def _counts(base: DataFrame, per_text: Callable[[Text], tuple[list[str], np.ndarray]], least: int, label: str) -> DataFrame:
    """(lang, phrase, f) of phrases with ``least`` places or more, or of the empty phrase; partial counts are shuffled."""
    def run(batches):
        for text in _texts(batches):
            phrases, times = per_text(text)
            yield pa.RecordBatch.from_arrays([pa.array([text.lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                                              pa.array(times, pa.int64())], names=["lang", "phrase", "f"])

    rows = base.mapInArrow(run, COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return kept(rows.where((F.col("f") >= least) | (F.col("phrase") == "")), label)


def _words_and_total(text: Text) -> tuple[list[str], np.ndarray]:
    times = np.bincount(text.ids, minlength=len(text.words))
    times[0] = times[1:].sum()
    return ["", *[w.decode() for w in text.words[1:]]], times


def _grown(growth) -> Callable[[Text], tuple[list[str], np.ndarray]]:
    def per_text(text: Text):
        own = growth.value
        return text.counted(own.places(text), own.length)
    return per_text


def _part(first: int, n: int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def _scored(table: DataFrame, length: int, parts: list[DataFrame], label: str) -> DataFrame:
    """``table`` with l, r and the score of its worst cut; ``parts`` has the counts of shorter phrases, by length.

    A phrase with a part that was not counted can't reach any threshold so far: its score is -1.
    """
    known = parts[0]
    for more in parts[1:]:
        known = known.unionByName(more)
    cuts = F.array(*[F.struct(F.lit(k).alias("k"), _part(1, k).alias("left"), _part(k + 1, length - k).alias("right")) for k in range(1, length)])
    rows = table.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "f", F.inline(cuts))
    wide = "decimal(38,0)"
    score = F.expr(f"coalesce(cast(f as {wide}) * cast({SCALE} as {wide}) div (cast(l as {wide}) + cast(r as {wide})), -1L)")
    rows = rows.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"], "left")
    rows = rows.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"], "left")
    worst = rows.withColumn("score", score).groupBy("lang", "phrase", "f").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return kept(worst.select("lang", "phrase", "f", "cut.score", "cut.l", "cut.r"), label)


def _thresholds(pairs: DataFrame, reach: int) -> DataFrame:
    """(lang, threshold): the highest step at or above which ``reach`` phrases score, or 0.  A step is the least of a few near scores."""
    near = F.floor(F.log1p(F.col("score")) * STEPS)
    steps = pairs.groupBy("lang", near.alias("near")).agg(F.min("score").alias("step"), F.count(F.lit(1)).alias("count"))
    above = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= reach, F.col("step"))), F.lit(0)).alias("threshold"))


def _threshold_slots(thresholds: DataFrame) -> np.ndarray:
    """Least threshold of each slot of languages; LANGUAGE_SLOTS rows at most come to the driver."""
    def run(batches):
        for batch in batches:
            slots = [_language_seed(x) % LANGUAGE_SLOTS for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), batch.column(1)], names=["slot", "threshold"])

    rows = (thresholds.select("lang", F.col("threshold").cast("bigint")).mapInArrow(run, "slot bigint, threshold bigint")
            .groupBy("slot").agg(F.min("threshold").alias("threshold")).toArrow())
    out = np.full(LANGUAGE_SLOTS, CLOSED, np.int64)
    out[rows["slot"].to_numpy()] = rows["threshold"].to_numpy()
    return out


def _survivors(levels: list[DataFrame], thresholds: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Candidates that reach their language's threshold and that no longer candidate holds enough of.

    A candidate inside a much longer one is inside one longer by a word, with as many places or more.
    """
    reached = [t.join(thresholds, "lang").where(F.col("score") >= F.col("threshold")) for t in levels]
    out = reached[-1].withColumn("most", F.lit(0).cast("bigint"))
    for m in range(len(levels) - 1, 0, -1):  # the phrases of m + 1 words
        ends = F.explode(F.array(_part(1, m + 1), _part(2, m + 1)))
        longer = (levels[m].withColumn("w", F.split("phrase", " ")).select("lang", ends.alias("phrase"), F.col("f").alias("more"))
                  .groupBy("lang", "phrase").agg(F.max("more").alias("most")))
        out = out.unionByName(reached[m - 1].join(longer, ["lang", "phrase"], "left").withColumn("most", F.coalesce("most", F.lit(0))))
    wide = "decimal(38,0)"
    return out.where(F.col("most").cast(wide) * share[1] < F.col("f").cast(wide) * share[0]).drop("most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = 30,
                 longest: int = 4, share: tuple[int, int] = (80, 100), slots: int = SLOTS, first_reach: int = REACH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` (at most 4) words of each language.

    A-Z count as a-z. Pieces end at ``. , ; : ! ?`` and line ends, words at spaces and tabs. Candidates have
    ``least`` places or more; one inside a longer candidate that has ``share`` of its places is dropped. n counts all
    words of the language. Rows go by score, count and phrase (UTF-8 byte order), so ties have one order. A null
    language counts as ``und``, null and empty texts have no words, repeated rows count again, very long texts are read
    whole, languages without candidates have no rows. Other columns are not read.
    """
    if not 2 <= longest <= 4:
        raise ValueError("phrases have two to four words")
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))
    everything = _counts(base, _words_and_total, least, "words")
    words, totals = everything.where("phrase <> ''"), everything.where("phrase = ''").select("lang", F.col("f").alias("n"))
    none = F.lit(False)
    word_bounds, everywhere = Bounds.of(words, none, slots), np.zeros(LANGUAGE_SLOTS, np.int64)

    def grow(length: int, bounds: list[Bounds], thresholds: np.ndarray) -> DataFrame:
        given = spark.sparkContext.broadcast(Growth(length, longest, least, share[0] / share[1], bounds, thresholds))
        return _counts(base, _grown(given), least, f"phrases_of_{length}")

    pairs = _scored(grow(2, [word_bounds], everywhere), 2, [words], "pairs")
    counts = ["lang", "phrase", "f"]
    settled, reach = None, first_reach * top
    open_langs = pairs.select("lang").distinct()
    while True:
        limits = kept(_thresholds(pairs.join(open_langs, "lang", "left_semi"), reach), "thresholds")
        thresholds = _threshold_slots(limits)
        levels, parts, bounds = [pairs], [words, pairs.select(*counts)], [word_bounds]
        for length in range(3, longest + 1):
            marked = levels[-1].join(limits, "lang", "left").select(*counts, F.coalesce(F.col("score") >= F.col("threshold"), none).alias("wanted"))
            bounds.append(Bounds.of(marked, F.col("wanted"), slots))
            levels.append(_scored(grow(length, bounds, thresholds), length, parts, f"scored_{length}"))
            parts.append(levels[-1].select(*counts))
        found = kept(_survivors(levels, limits, share), "survivors")
        done = kept(limits.join(found.groupBy("lang").count(), "lang", "left")
                    .where((F.col("threshold") == 0) | (F.coalesce("count", F.lit(0)) >= top)).select("lang"), "settled")
        part = found.join(done, "lang", "left_semi")
        settled = part if settled is None else settled.unionByName(part)
        open_langs = kept(limits.select("lang").join(done, "lang", "left_anti"), "open")
        if open_langs.isEmpty():
            break
        reach *= WIDER
    # only the steps of scores that hold the first ``top`` are sorted
    enough = kept(_thresholds(settled, top).withColumnRenamed("threshold", "enough"), "enough")
    settled = settled.join(enough, "lang").where(F.col("score") >= F.col("enough")).drop("enough")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    ranked = settled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def sql(top: int = 2000, least: int = 30) -> str:
    """The query's rows by counting everything."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest([w[i : i + m - 1] for i in range(1, len(w) - m + 2)]) AS g
          FROM worded, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m),
counted AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE len(g) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE len(g) >= 2 AND f >= {least}),
parts AS (SELECT c.lang, c.g, c.f AS a, k, c.g[1 : k] AS head, c.g[k + 1 :] AS tail
          FROM candidates c CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) AS ks WHERE k < len(c.g)),
cuts AS (SELECT p.lang, p.g, p.a, p.k, l.f AS l, r.f AS r, CAST(CAST({SCALE} AS HUGEINT) * p.a // (l.f + r.f) AS BIGINT) AS score
         FROM parts p JOIN counted l ON l.lang = p.lang AND l.g = p.head JOIN counted r ON r.lang = p.lang AND r.g = p.tail),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, sub, max(f) AS most
           FROM (SELECT lang, f, unnest([g[i : i + m - 1] for i in range(1, len(g) - m + 2)]) AS sub
                 FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < len(g)) GROUP BY ALL),
ranked AS (SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM worst w LEFT JOIN inside i ON i.lang = w.lang AND i.sub = w.g
           WHERE 100 * CAST(coalesce(i.most, 0) AS HUGEINT) < 80 * CAST(w.a AS HUGEINT))
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN totals USING (lang)
WHERE rank <= {top}"""
