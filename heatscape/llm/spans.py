"""Places of a pattern in a text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def tagged(spans: Column, kind: str) -> Column:
    """Spans with their kind."""
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found")))


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


SPAN = "struct<start: bigint, end: bigint, found: string>"


def places(text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of all matches, in code points and end exclusive, with the matched text.

    The matches and what stands between them give the places. Texts that fail ``gate`` are
    not searched; matches that fail ``keep`` are dropped after all have been found.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).cast("bigint").alias("b"), m.alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["b"]
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("found"))
        good = F.lit(True) if keep is None else keep(x["m"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(gate, F.aggregate(steps, start, step, lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def written(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """kind:start:end of structs (kind, start, end), by start and kind or by kind and start."""
    def key(s):
        rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
        order = [rank.alias("r"), s["start"].alias("s")] if by_kind else [s["start"].alias("s"), rank.alias("r")]
        return F.struct(*order, s["end"].alias("e"), s["kind"].alias("k"))

    ordered = F.array_sort(F.transform(spans, key))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def sql_places(text: str, pattern: str) -> str:
    """The same in DuckDB, as a list of structs; ``text`` is a column name."""
    p = "'" + pattern.replace("'", "''") + "'"
    m, b = f"regexp_extract_all({text}, {p})", f"string_split_regex({text}, {p})"
    return (f"list_transform(range(1, len({m}) + 1), lambda i: struct_pack(\"start\" := "
            f"CAST(coalesce(list_sum(list_transform({b}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0) AS BIGINT), "
            f"found := {m}[i]))")
