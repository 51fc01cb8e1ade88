"""Secrets in texts, and how widely each is copied, by DataFrame functions.

Candidates are found by patterns. Hashes of their values are counted over the whole corpus by
distinct repositories and owners: a value under several owners is a widely copied example, one
under a single owner looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import kept, text_or_empty
from heatscape.llm.spans import number_of, places, tagged, written

# The base patterns of the contract, in its order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8
BASE = ["assign", "access", "hex"]
#: Further kinds: pattern, and a text without which it can't match.
MORE = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", "gh"),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox"),
    "google": (r"AIza[0-9A-Za-z_-]{35}", "AIza"),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "eyJ"),
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "PRIVATE KEY-----"),
    "login": (r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._!$%-]{3,64}@", "://"),
    "bearer": (r"Bearer [A-Za-z0-9._~+/=-]{16,}", "Bearer "),
}
KINDS = [*BASE, *MORE]
#: A value under more owners than this is an example.
LIVE_OWNERS = 1


def value(kind: Column, found: Column) -> Column:
    """What is secret in a match: the assigned value, else the whole match."""
    return F.when(kind == "assign", F.regexp_extract(found, ASSIGN, 2)).otherwise(found)


def candidates(text: Column) -> Column:
    """Array of structs (kind, start, end, found) of all kinds."""
    found = {
        "assign": places(text, ASSIGN, text.rlike("(?i)passw(?:or)?d|secret|token|api_?key"),
                         lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        "access": places(text, ACCESS, text.contains("AKIA")),
        "hex": places(text, HEX, text.rlike(HEX)),
        **{k: places(text, p, text.contains(gate)) for k, (p, gate) in MORE.items()},
    }
    return F.concat(*[tagged(s, k) for k, s in found.items()])


def scan(docs: DataFrame, text_col: str = "text", repository: Column | str = "source", owner: Column | str | None = None,
         label: str = "row") -> DataFrame:
    """(row, secrets): the input's rows but for the text, and array of structs (kind, start, end, digest, repositories, owners, live).

    ``repository`` and ``owner`` are columns or expressions; the owner is by default what stands
    before the first slash of the repository. Rows without a repository count for no one: a value
    that only they have is under no owner and looks live. Null and empty texts have no secrets.
    A value in any number of rows is combined to a row a repository before it is counted.
    """
    repo = F.expr(repository) if isinstance(repository, str) else repository
    own = F.expr(owner) if isinstance(owner, str) else owner if owner is not None else F.substring_index(repo.cast("string"), "/", 1)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    found = docs.select(F.struct(*others).alias(label), repo.cast("string").alias("repository"), own.cast("string").alias("owner"),
                        candidates(text_or_empty(text_col)).alias("c"))
    found = found.withColumn("c", F.transform("c", lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
        F.sha2(value(x["kind"], x["found"]).cast("binary"), 256).alias("digest"))))
    found = kept(found.withColumn("uid", F.monotonically_increasing_id()), "candidates")
    each = found.where(F.size("c") > 0).select("uid", "repository", "owner", F.explode("c").alias("x")).select(
        "uid", "repository", "owner", "x.*")
    spread = (each.groupBy("digest", "repository", "owner").agg(F.count("*").alias("n")).groupBy("digest")
              .agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners")))
    judged = each.join(spread, "digest").select("uid", F.struct(
        "kind", "start", "end", "digest", "repositories", "owners", (F.col("owners") <= LIVE_OWNERS).alias("live")).alias("s"))
    secrets = judged.groupBy("uid").agg(F.sort_array(F.collect_list("s")).alias("secrets"))
    empty = F.expr(f"cast(array() as {dict(secrets.dtypes)['secrets']})")
    return found.join(secrets, "uid", "left").select(label, F.coalesce("secrets", empty).alias("secrets"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    base = F.filter("secrets", lambda s: s["kind"].isin(BASE))
    count = lambda test: F.size(F.filter("secrets", test)).cast("bigint")
    return scanned.select(
        F.col("row.doc_id"), *[number_of(F.col("secrets"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(base, KINDS, False), 256).alias("base_sha256"), written(F.col("secrets"), KINDS, False).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"))


def sql() -> str:
    """DuckDB SQL of the query over ``documents``."""
    from heatscape.llm.spans import sql_places

    def part(kind: str, pattern: str, gate: str) -> str:
        return f"SELECT doc_id, source, '{kind}' AS kind, {KINDS.index(kind)} AS r, unnest({sql_places('t', pattern)}) AS s FROM d WHERE {gate}"

    parts = [part("assign", ASSIGN, "regexp_matches(t, '(?i)passw(?:or)?d|secret|token|api_?key')"), part("access", ACCESS, "contains(t, 'AKIA')"),
             part("hex", HEX, f"regexp_matches(t, '{HEX}')"), *[part(k, p, f"contains(t, '{g}')") for k, (p, g) in MORE.items()]]
    assign = ASSIGN.replace("'", "''")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
c AS (
  SELECT doc_id, source, kind, r, s."start" AS b, s."start" + length(s.found) AS e, s.found AS f,
         CASE WHEN kind = 'assign' THEN regexp_extract(s.found, '{assign}', 2) ELSE s.found END AS v
  FROM ({' UNION ALL '.join(parts)})),
k AS (SELECT * FROM c WHERE kind <> 'assign' OR length(v) >= {ASSIGN_LEAST}),
w AS (SELECT v, count(DISTINCT split_part(source, '/', 1)) <= {LIVE_OWNERS} AS live FROM k GROUP BY v),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) FILTER (r < {len(BASE)}) AS base,
         string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, r) AS spans
  FROM k JOIN w USING (v) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (doc_id)
"""
