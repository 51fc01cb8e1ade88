"""Personal data in texts: generators of candidate spans, boosted trees, a calibrated threshold.

The base kinds are exact rules and always stay. Wide generators propose further, overlapping spans;
boosted trees over format and context features, trained on candidates whose format a checksum or a
rule decides, give each a probability, and a threshold chosen on candidates left out of the fit
selects. All of it is DataFrame functions and Spark's own trees.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import kept, text_or_empty
from heatscape.llm.spans import number_of, places, tagged, written

# The base patterns of the contract, in its order. \G and the look-behind keep the
# search from starting anew inside a run that has failed as a whole; repeated groups are possessive, because
# the engine would take a stack frame for each turn of another one. Neither changes a match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
#: Wide generators of further kinds: pattern and a gate.
MORE = {
    "mailbox": (r"[A-Za-z0-9._%+-]{2,64}\x20?[\[(]?(?:@|\x20at\x20)[\])]?\x20?[A-Za-z0-9-]{2,64}\x20?(?:\.|[\[(]dot[\])]|\x20dot\x20)\x20?[A-Za-z]{2,24}", r"@|[\[(\x20](?i:at)[\])\x20]"),
    "number": (r"\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,6}){2,5}", r"[0-9][)\x20.-]"),
    "account": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b", r"[A-Z]{2}[0-9]{2}"),
}
KINDS = [*BASE, *MORE]
CONTEXT = 24
#: Words before a span that speak of personal data.
CUES = r"(?i)tel|phone|mobile|call|fax|mail|contact|card|visa|account|iban|ssn|social|address|passport"
TREES, DEPTH = 12, 4
#: Bins of a feature of the trees; more where there are more different examples than their square.
LEAST_BINS = 32
PRECISION = 0.9
FEATURES = ["length", "digits", "letters", "marks", "groups", "plus", "at", "dots", "longest", "cue", "before", "behind", "caps", "checked"]


def is_ip(m: Column) -> Column:
    return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a match pass the checksum of payment cards."""
    digits = F.filter(F.split(F.reverse(digits_of(m)), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def is_card(m: Column) -> Column:
    n = F.length(digits_of(m))
    return F.when(n.between(16, 19), luhn(m)).otherwise(F.lit(False))


def is_phone(m: Column) -> Column:
    return F.length(digits_of(m)).between(8, 15)


def base_spans(text: Column) -> Column:
    found = {"email": places(text, EMAIL, text.contains("@")), "ip": places(text, IP, text.rlike(r"[0-9]\.[0-9]"), is_ip),
             "card": places(text, CARD, text.rlike(CARD), is_card), "phone": places(text, PHONE, text.contains("+"), is_phone)}
    return F.concat(*[tagged(s, k) for k, s in found.items()])


def _wide_spans(text: Column) -> Column:
    """Spans of the generators, and of the base patterns without their checks."""
    loose = {"ip": places(text, IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: ~is_ip(m)),
             "card": places(text, CARD, text.rlike(CARD), lambda m: ~is_card(m)),
             "phone": places(text, PHONE, text.contains("+"), lambda m: ~is_phone(m)),
             **{k: places(text, p, text.rlike(gate)) for k, (p, gate) in MORE.items()}}
    return F.concat(*[tagged(s, k) for k, s in loose.items()])


def _features(found: Column, left: Column, right: Column, kind: Column) -> dict[str, Column]:
    size = lambda pattern: F.length(found) - F.length(F.regexp_replace(found, pattern, ""))
    return {
        "length": F.length(found), "digits": size("[0-9]"), "letters": size("[A-Za-z]"), "marks": size("[^0-9A-Za-z]"),
        "groups": F.size(F.split(found, "[^0-9A-Za-z]+")), "plus": found.startswith("+"), "at": found.contains("@"), "dots": size(r"\."),
        "longest": F.array_max(F.transform(F.split(found, "[^0-9A-Za-z]+"), lambda x: F.length(x))), "cue": left.rlike(CUES),
        "before": left.rlike(r"[0-9A-Za-z]$"), "behind": right.rlike(r"^[0-9A-Za-z]"), "caps": size("[A-Z]"),
        # a checksum tells more than a format; not for the kinds whose label it is
        "checked": F.when(kind.isin("card", "phone", "ip"), F.lit(False)).otherwise(luhn(found)),
    }


def _context(text: Column, spans: Column) -> Column:
    """Spans with what stands around them."""
    return F.transform(spans, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"),
        F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(x["start"], F.lit(CONTEXT)).cast("int")).alias("left"),
        F.substring(text, (x["end"] + 1).cast("int"), F.lit(CONTEXT)).alias("right")))


def _model(examples: DataFrame):
    """(trees, threshold) fitted on all candidates with a label, a quarter left out for the threshold; None where one of the classes is missing."""
    known = kept(examples.withColumn("part", F.pmod(F.xxhash64("found", "left"), F.lit(4))), "examples")
    have = {tuple(r) for r in known.select(F.col("part") == 0, "label").distinct().collect()}
    if len(have) < 4:
        return None
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    # equal examples are one with their number as its weight; Spark takes the edges of bins from all rows if there are no more than bins times bins
    fit = kept(known.where("part <> 0").groupBy(*FEATURES, "label").agg(F.count("*").cast("double").alias("weight")), "weighted")
    bins = max(LEAST_BINS, math.isqrt(fit.count()) + 1)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7, featuresCol="features", labelCol="label", weightCol="weight",
                          cacheNodeIds=False).fit(assembler.transform(fit))
    held = trees.transform(assembler.transform(known.where("part = 0"))).select(
        "label", F.round(vector_to_array("probability")[1], 3).alias("p"))
    at = held.groupBy("p").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy(F.desc("p")).collect()  # 1001 rows at most
    best, good, n = None, 0, 0
    for r in at:
        good, n = good + r["good"], n + r["n"]
        if good >= PRECISION * n:
            best = r["p"]
    return None if best is None else (assembler, trees, float(best))


def _rows(frame: DataFrame, extra: list) -> DataFrame:
    x = F.col("x")
    made = _features(x["found"], x["left"], x["right"], x["kind"])
    return frame.select(*extra, x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"),
                        x["left"].alias("left"), x["right"].alias("right"), *[c.cast("double").alias(k) for k, c in made.items()])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, base, more): the input's rows but for the text, spans of the base kinds, and spans the trees add.

    Spans are structs (kind, start, end), more has probability too. A span that overlaps a base
    span is not added; of overlapping added ones the likelier stays, then the longer. Null and
    empty texts have no spans. Where no examples of both sorts exist nothing is added.
    """
    text = text_or_empty(text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = docs.select(F.struct(*others).alias("row"), text.alias("t")).select(
        "row", "t", base_spans(F.col("t")).alias("b"), _wide_spans(F.col("t")).alias("w"))
    found = kept(found.select("row", _context(F.col("t"), F.col("b")).alias("b"), _context(F.col("t"), F.col("w")).alias("w"))
                 .withColumn("uid", F.monotonically_increasing_id()), "spans")
    good = _rows(found.select(F.explode("b").alias("x")), []).withColumn("label", F.lit(1))
    # what the base kinds' own checks turn down is no personal data of that kind; other generators' spans have no label
    bad = _rows(found.select(F.explode(F.filter("w", lambda x: x["kind"].isin(BASE))).alias("x")), []).withColumn("label", F.lit(0))
    loose = _rows(found.select(F.explode(F.filter("w", lambda x: x["kind"].isin("number") & (F.length(digits_of(x["found"])) < 7))).alias("x")), []).withColumn("label", F.lit(0))
    spans = "array<struct<kind: string, start: bigint, end: bigint, probability: double>>"
    base = F.transform("b", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base")
    model = _model(good.unionByName(bad).unionByName(loose))
    if model is None:
        return found.select("row", base, F.expr(f"cast(array() as {spans})").alias("more"))
    assembler, trees, threshold = model
    apart = F.filter("w", lambda x: x["kind"].isin(list(MORE)) & ~F.exists("b", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    wide = _rows(found.select("uid", F.explode(apart).alias("x")), ["uid"])
    judged = trees.transform(assembler.transform(wide)).select(
        "uid", F.struct("kind", "start", "end", vector_to_array("probability")[1].alias("probability")).alias("s")).where(
        F.col("s.probability") >= threshold)
    each = judged.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(
        F.col("s.start").alias("a"), (-F.col("s.probability")).alias("p"), (-F.col("s.end")).alias("e"), "s"))).alias("s"))
    empty = F.expr(f"cast(array() as {spans})")

    def step(acc, x):
        last = F.element_at(acc, -1)
        return (F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= x["s"]["start"]), F.concat(acc, F.array(x["s"])))
                .when(x["s"]["probability"] > last["probability"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x["s"]))).otherwise(acc))

    chosen = each.select("uid", F.aggregate("s", empty, step).alias("more"))
    return found.join(chosen, "uid", "left").select("row", base, F.coalesce("more", empty).alias("more"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    every = F.concat("base", F.transform("more", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return scanned.select(
        F.col("row.doc_id"),
        *[number_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("base"), KINDS, True), 256).alias("base_sha256"), written(every, KINDS, True).alias("spans"))
