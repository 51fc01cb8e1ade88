"""License notices in texts by ordered signature rules, as column expressions.

A text becomes its lower-cased words. Rules are patterns over words; only those run whose keyword
the text has. Of detections one of which contains the other the longer stays, of equal ones that
of the higher priority, then the earlier rule.
"""

from __future__ import annotations

import json
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import text_or_empty
from heatscape.llm.spans import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases and labels of the contract.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


class Rule(NamedTuple):
    label: str
    words: str  # a pattern over words with one space between them
    keyword: str  # words that every match has
    priority: int
    weight: float


#: Names of licences: label, pattern of the name, keyword in it, versions.
FAMILIES = [
    ("apache", "apache( software)? license", "apache", ["2 0", "1 1", "1 0"]),
    ("gpl", "gnu general public license", "gnu general public license", ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", "gpl", ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "(gnu )?lesser general public license", "lesser general public license", ["2 1", "3", "3 0"]),
    ("lgpl", "(gnu )?library general public license", "library general public license", ["2", "2 0"]),
    ("lgpl", "lgpl", "lgpl", ["2 1", "3", "3 0", "2 0"]),
    ("agpl", "(gnu )?affero general public license", "affero general public license", ["3", "3 0"]),
    ("agpl", "agpl", "agpl", ["3", "3 0"]),
    ("gfdl", "(gnu )?free documentation license", "free documentation license", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla public license", "mozilla", ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", "mpl", ["1 1", "2 0"]),
    ("epl", "eclipse public license", "eclipse", ["1 0", "2 0"]),
    ("edl", "eclipse distribution license", "eclipse", ["1 0"]),
    ("cddl", "common development and distribution license", "common development and distribution", ["1 0", "1 1"]),
    ("cpl", "common public license", "common public license", ["1 0"]),
    ("eupl", "european union public licen[cs]e", "european union public", ["1 1", "1 2"]),
    ("artistic", "artistic license", "artistic", ["1 0", "2 0"]),
    ("bsl", "boost software license", "boost", ["1 0"]),
    ("busl", "business source license", "business source", ["1 1"]),
    ("sspl", "server side public license", "server side public", ["1"]),
    ("odbl", "open database license", "open database", ["1 0"]),
    ("ofl", "(sil )?open font license", "open font", ["1 0", "1 1"]),
    ("osl", "open software license", "open software license", ["2 1", "3 0"]),
    ("afl", "academic free license", "academic free", ["2 1", "3 0"]),
    ("zpl", "zope public license", "zope", ["2 0", "2 1"]),
    ("psf", "python software foundation license", "python software foundation", ["2"]),
    ("php", "php license", "php", ["3 0", "3 01"]),
    ("ms-pl", "microsoft public license", "microsoft public", []),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal", []),
    ("unlicense", "unlicense", "unlicense", []),
    ("wtfpl", "do what the [^ ]+ you want to public license", "do what the", ["2"]),
    ("zlib", "zlib( libpng)? license", "zlib", []),
    ("isc", "isc license", "isc", []),
    ("mit", "mit( x11)? license", "mit", []),
    ("bsd-2", "(simplified|freebsd) (bsd )?license", "license", []),
    ("bsd-2", "(2|two) clause bsd( license)?", "clause bsd", []),
    ("bsd-3", "(3|three) clause bsd( license)?", "clause bsd", []),
    ("bsd-4", "(4|four) clause bsd( license)?", "clause bsd", []),
    ("bsd-2", "bsd 2 clause( license)?", "bsd 2 clause", []),
    ("bsd-3", "bsd 3 clause( license)?", "bsd 3 clause", []),
    ("bsd-3", "(new|modified|revised) bsd license", "bsd", []),
    ("bsd", "bsd license", "bsd", []),
    ("postgresql", "postgresql license", "postgresql", []),
    ("openssl", "openssl license", "openssl", []),
    ("llama", "llama( 2| 3)? community license", "community license", []),
    ("rail", "(creativeml )?open rail( m| plus m)? license", "rail", []),
]
#: What stands before a name in a notice; with it a detection is surer than a mere name.
OPENINGS = ["(re)?licensed under( the)?( terms of)?( the)?", "(released|distributed|available|published|redistributed) under( the)?( terms of)?( the)?",
            "under the terms of( the)?", "subject to( the)?( terms of)?( the)?", "is governed by( the)?"]
#: Sentences of licence texts and other notices.
NOTICES = [
    Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", 60, 1.0),
    Rule("mit", "the software is provided as is without warranty of any kind", "the software is provided", 50, 0.8),
    Rule("mit", "to use copy modify merge publish distribute sublicense and or sell copies", "sublicense", 50, 0.9),
    Rule("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify", 60, 1.0),
    Rule("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use", 60, 1.0),
    Rule("bsd-3", "neither the name of [^ ]+( [^ ]+){0,12} nor the names of its contributors", "neither the name of", 60, 0.9),
    Rule("bsd-4", "all advertising materials mentioning features or use of this software", "advertising materials", 60, 0.9),
    Rule("zlib", "this software is provided as is without any express or implied warranty", "express or implied warranty", 60, 0.9),
    Rule("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 60, 1.0),
    Rule("public-domain", "(released|placed|dedicated) (in|into|to) the public domain", "public domain", 50, 0.9),
    Rule("public-domain", "public domain", "public domain", 20, 0.4),
    Rule("cc0", "cc0( 1 0)?( universal)?", "cc0", 50, 0.9),
    Rule("cc0", "creative commons zero", "creative commons zero", 50, 0.9),
    Rule("apache", "apache org licenses license 2 0", "apache org licenses", 60, 0.9),
    Rule("gpl", "gnu org licenses (old licenses )?gpl( [0-9]+){0,2}( html| txt)?", "gnu org licenses", 60, 0.9),
    Rule("lgpl", "gnu org licenses (old licenses )?lgpl( [0-9]+){0,2}( html| txt)?", "gnu org licenses", 60, 0.9),
    Rule("agpl", "gnu org licenses agpl( [0-9]+){0,2}( html| txt)?", "gnu org licenses", 60, 0.9),
    Rule("mit", "opensource org licenses mit( license)?", "opensource org licenses", 60, 0.9),
    Rule("bsd", "opensource org licenses bsd( [23] clause| license)?", "opensource org licenses", 60, 0.9),
    Rule("gpl", "this program is free software you can redistribute it and or modify it", "you can redistribute it", 60, 1.0),
    Rule("lgpl", "this library is free software you can redistribute it and or modify it", "you can redistribute it", 60, 1.0),
    Rule("proprietary", "proprietary and confidential", "proprietary", 50, 0.7),
    Rule("proprietary", "unauthorized (copying|reproduction|distribution)( of this (file|document))?", "unauthorized", 50, 0.6),
    Rule("proprietary", "may not be (reproduced|copied|distributed)( or (reproduced|copied|distributed))* without", "may not be", 50, 0.6),
    Rule("copyright", "copyright( c)?( [0-9]{4}){1,4}", "copyright", 30, 0.3),
    Rule("copyright", "copyright (notice|holders?|owners?)", "copyright", 20, 0.2),
    Rule("licensed", "(re)?licensed under", "licensed under", 10, 0.2),
    Rule("licensed", "licen[cs]e agreement", "agreement", 10, 0.2),
    Rule("licensed", "terms of (use|service)", "terms of", 10, 0.1),
]


def rules() -> list[Rule]:
    """All rules: base phrases, notices, names, names with versions, with openings, tags, and Creative Commons kinds."""
    out = [Rule(label, phrase, phrase, 100, 0.6 if label != "reserved" else 0.3) for phrase, label in BASE] + NOTICES
    for label, name, keyword, versions in FAMILIES:
        version = f"( version| v)?( ({'|'.join(versions)}))( or later| only)?" if versions else ""
        named = " " in name
        out.append(Rule(label, name, keyword, 40 if named else 15, 0.6 if named else 0.3))
        for v in versions:
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", f"{name}( version| v)? {v}( or later| only)?", keyword, 70, 0.9))
        for opening in OPENINGS:
            out.append(Rule(label, f"{opening} {name}", keyword, 45, 0.8))
            if version:
                out.append(Rule(f"{label}-versioned", f"{opening} {name}{version}", keyword, 42, 0.9))
        out.append(Rule(label, f"spdx license identifier {name.replace(' license', '( license)?')}", "spdx license identifier", 80, 1.0))
    for kind, v in product(["", " nc", " nd", " sa", " nc sa", " nc nd"], ["1 0", "2 0", "2 5", "3 0", "4 0"]):
        out.append(Rule(f"cc-by{kind.replace(' ', '-')}-{v.replace(' ', '.')}", f"(creative commons )?cc by{kind} {v}( international| unported)?", "cc by", 75, 0.9))
    for kind, words in (("", ""), ("-nc", " noncommercial"), ("-nd", " noderivatives"), ("-sa", " sharealike"),
                        ("-nc-sa", " noncommercial sharealike"), ("-nc-nd", " noncommercial noderivatives")):
        out.append(Rule(f"cc-by{kind}", f"creative commons attribution{words}( [0-9] [0-9])?( international| unported)?( license)?", "creative commons", 70, 0.9))
        out.append(Rule(f"cc-by{kind}", f"creativecommons org licenses by{kind.replace('-', ' ')}( [0-9] [0-9])?", "creativecommons org", 70, 0.9))
    return out


def _pattern(words: str) -> str:
    """Over words each of which has a space of its own on both sides, so that matches share none."""
    return f" {words.replace(' ', '  ')} "


def spaced(text: Column) -> Column:
    """Words of a text, each between two spaces. Full lower-casing changes no word's ASCII letters
    and divides no word, so it gives the same matches as that of A-Z alone."""
    return let(F.trim(F.regexp_replace(F.lower(text), SEPARATORS, " ")), lambda words: F.when(words == "", F.lit("")).otherwise(
        F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))))


def _n_words(part: Column) -> Column:
    """Words of a part that was cut between words."""
    return ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("bigint")


DETECTION = "struct<first: bigint, back: bigint, worth: int, rule: int, label: string, weight: double>"


def _found(words: Column, rule: Column) -> Column:
    """Detections of one rule; ``back`` is minus the word behind the last, ``worth`` minus the priority, for sorting."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    between = F.split(words, rule["pattern"], -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(_n_words(b).alias("b"), _n_words(m).alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("out"))

    def step(acc, x):
        first = acc["at"] + x["b"]
        behind = first + x["m"]
        one = F.struct(first.alias("first"), (-behind).alias("back"), (-rule["priority"]).alias("worth"), rule["rule"].alias("rule"),
                       rule["label"].alias("label"), rule["weight"].alias("weight"))
        return F.struct(behind.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _rule_array(listed: list[tuple[int, Rule]]) -> Column:
    """All rules as one constant."""
    rows = [{"rule": i, "label": r.label, "pattern": _pattern(r.words), "keyword": _pattern(r.keyword), "priority": r.priority, "weight": r.weight}
            for i, r in listed]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule: int, label: string, pattern: string, keyword: string, priority: int, weight: double>>")


def _unsuppressed(found: Column) -> Column:
    """Detections that no earlier one of the order (first, longest, highest priority, rule) contains."""
    start = F.struct(F.lit(-1).cast("bigint").alias("far"), F.expr(f"cast(array() as array<{DETECTION}>)").alias("out"))

    def step(acc, x):
        return F.when(-x["back"] > acc["far"], F.struct((-x["back"]).alias("far"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, base, detections): the input's rows but for the text, base places and what is left of all detections.

    Null and empty texts have no words and no detections; repeated rows are scanned each for itself.
    """
    listed = list(enumerate(rules()))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    keywords = sorted({_pattern(r.keyword) for _, r in listed})
    empty = F.expr(f"cast(array() as array<{DETECTION}>)")

    def found(words: Column) -> Column:
        has = F.filter(F.from_json(F.lit(json.dumps(keywords)), "array<string>"), lambda k: F.contains(words, k))
        return let(has, lambda h: F.when(F.size(h) > 0, F.flatten(F.transform(
            F.filter(_rule_array(listed), lambda r: F.array_contains(h, r["keyword"])), lambda r: _found(words, r)))).otherwise(empty))

    def scanned(words: Column) -> Column:
        return let(found(words), lambda f: F.struct(
            _n_words(words).alias("n_words"), F.array_sort(F.filter(f, lambda x: x["rule"] < len(BASE))).alias("base"),
            _unsuppressed(f).alias("detections")))

    # one expression of a row, so that nothing is computed twice
    rows = docs.select(F.struct(*others).alias("row"), let(spaced(text_or_empty(text_col)), scanned).alias("x"))
    return rows.select("row", "x.n_words", "x.base", "x.detections")


def digest_columns(scanned: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("base", lambda x: x["label"])
    return scanned.select(
        F.col("row.doc_id"), "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["first"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("detections", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["weight"])), F.lit(0.0)).alias("score"))


def sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    def q(text):
        return "'" + str(text).replace("'", "''") + "'"

    values = ", ".join(f"({i}, {q(r.label)}, {q(_pattern(r.words))}, {q(_pattern(r.keyword))}, {r.priority}, CAST({r.weight} AS DOUBLE))"
                       for i, r in enumerate(rules()))
    n = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    return f"""
WITH rule(rule, label, pattern, keyword, priority, weight) AS (VALUES {values}),
t AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        {q(SEPARATORS)}, ' ', 'g'), ' ') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN w = '' THEN '' ELSE ' ' || replace(w, ' ', '  ') || ' ' END AS w FROM t),
hit AS (SELECT doc_id, rule, label, priority, weight, regexp_extract_all(w, pattern) AS m, string_split_regex(w, pattern) AS b
        FROM d JOIN rule ON contains(w, keyword)),
place AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit),
f AS (
  SELECT doc_id, rule, label, priority, weight, {n('m[i]')} AS size,
         CAST(list_sum(list_transform(b[1:i], lambda x: {n('x')})) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: {n('x')})), 0) AS BIGINT) AS first
  FROM place),
far AS (SELECT *, max(first + size) OVER (PARTITION BY doc_id ORDER BY first, size DESC, priority DESC, rule
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM f),
g AS (
  SELECT doc_id, count(*) FILTER (rule < {len(BASE)}) AS n_base, min(first) FILTER (rule < {len(BASE)}) AS first_word,
         max(first) FILTER (rule < {len(BASE)}) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rule < {len(BASE)}) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rule < {len(BASE)} OR far IS NULL OR first + size > far) AS labels,
         max(weight) FILTER (far IS NULL OR first + size > far) AS score
  FROM far GROUP BY doc_id)
SELECT doc_id, CAST({n('w')} AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""
