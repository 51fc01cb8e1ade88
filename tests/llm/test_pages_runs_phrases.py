"""Main text, periodic runs and collocations against brute force, SQL and known truth, on small tables with awkward rows."""

import collections
import hashlib
import html
import random
import re
import sys
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connection, difference  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- periodic runs


def all_runs(w, least=24, times=3):
    out = []
    for d in range(1, len(w) // times + 1):
        i = d
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - d]:
                j += 1
            start, end = i - d, j
            if end - start >= max(least, times * d) and not any(all(w[x] == w[x - q] for x in range(start + q, end)) for q in range(1, d)):
                out.append((start, end - start, d))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    from heatscape.llm.periodic import runs_of

    rng = random.Random(1)
    for _ in range(400):
        n, k = rng.randint(0, 220), rng.choice([1, 2, 2, 3, 5, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n > 9 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, a + rng.randint(0, n - a)):
                w[i] = w[a + (i - a) % p]
        for least, times in ((24, 3), (5, 3), (12, 4), (40, 3), (1, 3)):
            assert runs_of(w, least, times) == all_runs(w, least, times)
    with pytest.raises(ValueError, match="three times"):
        runs_of(["a"] * 50, 24, 2)


def test_runs_of_very_long_texts():
    from heatscape.llm.periodic import runs_of

    assert runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    blocks = (["a"] * 3000 + ["b"]) * 60
    assert runs_of(blocks) == sorted([(3001 * k, 3000, 1) for k in range(60)] + [(0, len(blocks), 3001)], key=lambda r: (r[0], r[2]))
    x, y = ["a"], ["a", "b"]
    while len(y) < 400:
        x, y = y, y + x
    assert runs_of(y) == all_runs(y) and runs_of(y)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with nulls, empty and long texts and repeated rows; extra columns clash with names the operators use."""
    given = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    given += [(9001, None, "en"), (9002, "", None), (9003, " \n\t ", "en"), (9004, "a " * 5000, "en"), (9005, "the and " * 4000, None),
              (9006, "x\x0by\x0cz " * 30, "und"), (9007, "a b " * 40, "de"), (9008, "Mixed Case words. mixed case WORDS, " * 50, "zz"),
              (9008, "Mixed Case words. mixed case WORDS, " * 50, "zz"), (None, "no id " * 20, "zz"), (9010, "ÉÉ éé\t日本 " * 60, "zz")]
    df = spark.createDataFrame(given, "doc_id long, text string, lang string")
    return df.withColumns({"row": F.lit(1), "runs": F.lit("x"), "phrase": F.lit("y"), "n": F.lit(2), "collapsed": F.lit(None).cast("string")})


def test_runs_of_documents(spark, docs):
    from heatscape.llm import periodic

    wanted = collections.Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, h = len(w), None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [*w[:a], *(w[a + (i - a) % p] for i in range(a, n))]
        runs = periodic.runs_of(w) if n > 1500 else all_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        wanted[(r["doc_id"], len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
                hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    got = periodic.digest_columns(periodic.find_runs(periodic.with_planted_runs(docs)))
    assert collections.Counter(map(tuple, got.collect())) == wanted
    assert sum(x[1] for x in wanted) > 20
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digest_columns(periodic.find_runs(periodic.with_planted_runs(none))).count() == 0


# ---- collocations


def all_collocations(rows, top, least):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts[lang].update(tuple(w[j : j + m]) for m in range(1, 5) for j in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        dropped = {k[j : j + m] for k, v in found.items() for m in range(2, len(k)) for j in range(len(k) - m + 1) if 100 * v >= 80 * c[k[j : j + m]]}
        ranked = []
        for k, a in found.items():
            if k not in dropped:
                score, cut = min((2000000 * a // (c[k[:j]] + c[k[j:]]), j) for j in range(1, len(k)))
                ranked.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("top", "least", "slots"), [(2000, 30, 1 << 21), (5, 3, 1 << 21), (40, 3, 1 << 8)])
def test_collocations(spark, docs, top, least, slots):
    """Few wanted phrases settle early and in several rounds; small tables of bounds share their slots."""
    from heatscape.llm import phrases

    got = phrases.collocations(docs, top=top, least=least, slots=slots, first_reach=1)
    columns = "lang rank phrase a l r n score".split()
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == all_collocations(((r["lang"], r["text"]) for r in docs.collect()), top, least)


def test_collocations_of_nothing(spark):
    from heatscape.llm import phrases

    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "a b", "en")], none.schema)).count() == 0
    with pytest.raises(ValueError, match="two to four"):
        phrases.collocations(none, longest=5)


def test_collocations_equal_sql(spark):
    from heatscape.llm import queries

    assert difference(queries.QUERIES["op13_collocations"](spark, FOLDER), connection(FOLDER), queries.SQL["op13_collocations"]) is None


# ---- main text


@pytest.fixture(scope="module")
def model(spark):
    from heatscape.llm import pages

    return pages.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def article_of(page):
    """The truth for the test tables: text of the one article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", s)).split()) for s in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(x for x in lines if x)


def test_main_text_of_all_pages(spark, model):
    """The network was fitted on a smaller table; none of the pages of this one is cut out wrong."""
    from heatscape.llm import pages

    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = pages.extract(table, model).select("row.html", "text").collect()
    assert len(rows) == table.count()
    assert [r["text"][:80] for r in rows if r["text"] != article_of(r["html"])] == []


def test_main_text_of_other_layouts(model):
    from heatscape.llm import pages

    rng = random.Random(99)
    names = pages.Names()
    texts = [b.text for k in range(200) for b in pages.blocks_of(pages.composed_page(rng, ["one two three four five six seven", "Ein Satz mit Wörtern."], ["A long sentence of an article, with words."]), names)]
    made = [pages.blocks_of(pages.composed_page(rng, texts, texts), names) for _ in range(300)]
    marked = model.label(made, {})
    right = np.concatenate([m == np.array([bool(b.label) for b in p]) for p, m in zip(made, marked, strict=True)])
    assert right.mean() > 0.96
    page = """<html><body><div class=cookie-banner>We use cookies. <button>Accept all</button></div><div id="header"><a href=/>The Journal</a></div>
      <ul class="menu"><li><a href="/a">Home<li><a href="/b">About</a></ul><div class="sidebar"><h3>Recent posts</h3><ul><li><a href=x>Other story</a></ul></div>
      <main><h1>A title &amp; more</h1><p>First   paragraph of <b>bold</b>
      text.<p>Second one, with a <a href="#">link</a>.<script>var p = "<p>no</p>";</script><ul><li>point one<li>point two</ul>
      <div class="advertisement">Buy now</div><p>Last words.</main>
      <section id="comments"><h2>3 comments</h2><div class="comment"><p>I think that this is a fine text, really.</p></div></section>
      <form class="newsletter">Subscribe <input name=e></form><footer>&copy; 2024 The Journal</footer></body>"""
    blocks = pages.blocks_of(page)
    [marked] = model.label([blocks], {})
    assert [b.text for b, m in zip(blocks, marked, strict=True) if m] == [
        "A title & more", "First paragraph of bold text.", "Second one, with a link.", "point one", "point two", "Last words."]


def test_blocks():
    from heatscape.llm.pages import blocks_of

    def texts(page):
        return [b.text for b in blocks_of(page)]

    assert texts("") == [] and texts("<p></p> <!-- x --><br>") == []
    assert texts("plain &amp text &lt;b&gt; &#x41;&am") == ["plain & text <b> A&am"]
    assert texts("<p title='a>b' data-x=it's>one<b>two</b> <i>three<p>four") == ["onetwo three", "four"]
    assert texts('a<!-- <p>no --> b<![CDATA[c]]>d</ x>e') == ["a bde"]
    assert texts("1 < 2 <3<p>x</p") == ["1 < 2 <3", "x"]
    assert texts("<script>a<!--</script>b<style>c") == ["b"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d<br>e") == ["a", "b", "c", "d e"]
    assert texts('<a href="unclosed>x</a>y') == ["xy"]
    assert texts("<p>" * 3000 + "x" + "<div>" * 3000 + "y") == ["x", "y"]
    assert len(blocks_of("<div>z" * 20_000)) == 20_000


def test_gradients():
    from heatscape.llm import pages

    rng, names = random.Random(5), pages.Names()
    texts = ["one two three", "Vier fünf sechs sieben."]
    made = [p for p in (pages.blocks_of(pages.composed_page(rng, texts, texts), names) for _ in range(6)) if p][:3]
    net, batch = pages.Labeller(3), pages.Batch(made, {})
    y = np.array([b.label or 0 for p in made for b in p], float)
    net.w = {k: v.astype(float) for k, v in net.w.items()}

    def loss():
        z = net.forward(batch)
        return float((np.logaddexp(0, z) - y * z).mean())

    for name, g in net.gradients(batch, y, np.ones(len(y))).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        value, both = net.w[name][at], []
        for e in (1e-3, -1e-3):
            net.w[name][at] = value + e
            both.append(loss())
        net.w[name][at] = value
        assert abs((both[0] - both[1]) / 2e-3 - g[at]) < 1e-4, name


def test_awkward_pages(spark, model):
    from heatscape.llm import pages

    given = [(1, None), (2, ""), (3, "no tags at all"), (4, "<script>x"), (5, "<article>" + "<p>word &amp; word" * 30_000), (5, "<article>x</article>"), (5, "<article>x</article>")]
    df = spark.createDataFrame(given, "page_id long, html string").withColumns({"row": F.lit(1), "text": F.lit("t"), "blocks": F.lit("b")})
    rows = pages.extract(df, model).select("row.page_id", "row.text", F.col("text").alias("got")).collect()
    assert len(rows) == len(given) and {r["text"] for r in rows} == {"t"}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r["got"])
    assert by[1] == [""] and by[2] == [""] and by[4] == [""]
    assert sorted(map(len, by[5])) == [1, 1, len("word & word\n") * 30_000 - 1]
    none = spark.createDataFrame([], "page_id long, html string")
    assert pages.extract(none, pages.fit(none)).count() == 0
