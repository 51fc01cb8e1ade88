"""Main text of web pages: a recurrent network labels every block of a page as article or not.

A page is cut into blocks, the runs of text between block-level tags. A block is read as the vector of
its tag path (elements, classes and ids around it), that of its hashed words and a few numbers; a
bidirectional LSTM over all blocks of the page gives each one's probability. The network is trained
here: on pages of the table whose markup says what is article, and on pages composed from their texts
in many layouts, whose labels are known by construction.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatscape.llm.common import text_or_empty, with_columns

TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"  # comments
    r"|(/?)([A-Za-z][^\s/>]*)((?:[^\"'>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)"  # tags; an end without > has no text after it
    r"|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role|itemprop|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# HTML elements by how they are read.
RAW = set("script style textarea title iframe noembed noframes xmp plaintext template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
             "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
             "option": ("select",)}
# Markup that says what a block is, for labels of training pages.
ARTICLE = set("article main".split())
BOILER = set("nav footer aside form menu dialog noscript button select".split())
BOILER_NAMES = set("ad ads advert advertisement sponsor sponsored promo nav navbar menu breadcrumb breadcrumbs sidebar widget related "
                   "footer cookie cookies consent notice newsletter subscribe login search comment comments reply share social".split())
PATHS, WORDS = 1 << 10, 1 << 12
NUMBERS, WIDTH, HIDDEN_UNITS = 10, 24, 24
#: Bounds of the fit: pages of the table by hash order, characters and blocks read of each, composed pages.
FIT_PAGES, FIT_CHARS, FIT_BLOCKS, COMPOSED = 400, 60_000, 120, 1_200
ROUNDS, BATCH, RATE = 5, 32, 0.01
#: Blocks (with padding) and characters that are labelled at once.
CELLS, SLICE = 60_000, 2_000_000


class Block:
    __slots__ = ("text", "path", "linked", "label")

    def __init__(self, text: str, path: tuple, linked: int, label: int | None):
        self.text, self.path, self.linked, self.label = text, path, linked, label


def _place(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}:{name}".encode()) % PATHS


class Names:
    """Path tokens of tags; remembers those it has seen."""

    def __init__(self):
        self.known: dict = {}

    def of(self, tag: str, attributes: str) -> tuple[frozenset, list[str], int | None]:
        """Numbers of the tokens, names in class and id, and a label given in the markup."""
        key = (tag, attributes)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 50_000:
                self.known = {}
            names, label = [], None
            if "=" in attributes:
                for name, value in ATTRIBUTE.findall(attributes):
                    if name.lower() == "data-label":
                        label = int(value.strip("\"'") == "1")
                    else:
                        names += [p.lower() for p in NAME_PART.findall(value)]
            own = {_place("in", tag), *(_place("name", n) for n in names)}
            if attributes and HIDDEN.search(attributes):
                own.add(_place("name", "hidden"))
            found = self.known[key] = (frozenset(own), names, label)
        return found


def blocks_of(page: str, names: Names | None = None, labeller: Callable | None = None) -> list[Block]:
    """The page's blocks with text, in order.

    Text of scripts, styles, titles and other raw elements is left out. References are decoded and white
    space, ``br`` included, becomes one space. Missing end tags are supplied for paragraphs, list items and cells.
    ``labeller(tag, names, outer)`` gives an element's label, that of its blocks.
    """
    names = names or Names()
    root = (None, frozenset([_place("in", "page")]), None)
    stack, out, parts, linked, links = [root], [], [], 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            tags = [e[0] or "page" for e in stack[-2:]]
            near = (_place("leaf", tags[-1]), _place("up", tags[0]))
            out.append(Block(text, (*sorted(stack[-1][1]), *near), linked, stack[-1][2]))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text)

    def close(down_to: int) -> None:
        nonlocal links
        links -= sum(e[0] == "a" for e in stack[down_to:])
        del stack[down_to:]

    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos : m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in INLINE
        if m.group(1):
            at = len(stack) - 1
            while at and stack[at][0] != tag and not (inline and stack[at][0] not in INLINE):
                at -= 1
            if not inline:
                flush()
            if at and stack[at][0] == tag:
                close(at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if not inline:
            flush()
            if tag in ENDS_P:
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] not in INLINE), 0)
                if at and stack[at][0] == "p":
                    close(at)
            if tag in ENDS_SAME:
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag or stack[k][0] in ENDS_SAME[tag]), 0)
                if at and stack[at][0] == tag:
                    close(at)
                elif tag in ("td", "th"):
                    at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ("td", "th", "tr", "table")), 0)
                    if at and stack[at][0] in ("td", "th"):
                        close(at)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos) if tag != "plaintext" else None
            pos = end.end() if end else size
            continue
        if tag in VOID:
            continue
        own, words, label = names.of(tag, m.group(3))
        outer = stack[-1]
        if label is None:
            label = labeller(tag, words, outer[2]) if labeller else outer[2]
        stack.append((tag, outer[1] if own <= outer[1] else outer[1] | own, label))
        links += tag == "a"
    flush()
    return out


def markup_label(tag: str, names: list[str], outer: int | None) -> int | None:
    """1 inside articles, 0 in what the markup names as something else, None where it does not say."""
    if outer == 0 or tag in BOILER or any(n in BOILER_NAMES for n in names):
        return 0
    return 1 if tag in ARTICLE or "articlebody" in "".join(names) else 0 if outer is None and tag == "header" else outer


# ---- features


def _numbers(b: Block, at: int, n: int) -> list[float]:
    t, size = b.text, len(b.text)
    # lengths beyond those of the fit say no more than the longest there
    stops = sum(t.count(c) for c in ".,;:!?。、，")
    return [np.log1p(min(size, 5000)) / 5, min(1.0, b.linked / size), min(1.0, 10 * stops / size), float(t[-1] in ".!?。\"”"),
            float(t[0].isupper()), min(1.0, 5 * sum(map(t.count, "0123456789")) / size), float("©" in t), at / n, float(at == 0), np.log1p(min(n, FIT_BLOCKS)) / 5]


class Batch:
    """Features of the blocks of some pages, one after the other, and where each stands in the padded table (time, page)."""

    def __init__(self, pages: list[list[Block]], cache: dict):
        rows = [b for p in pages for b in p]
        self.paths = np.fromiter((k for b in rows for k in b.path), np.int64)
        self.path_at = np.concatenate([[0], np.cumsum([len(b.path) for b in rows])])[:-1]
        words = []
        for b in rows:
            own = set()
            for w in b.text.lower().split():
                k = cache.get(w)
                if k is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    k = cache[w] = zlib.crc32(w.strip(".,;:!?()\"'«»").encode("utf-8", "replace")) % WORDS
                own.add(k)
            words.append(sorted(own))
        self.words = np.fromiter((k for w in words for k in w), np.int64)
        self.words_n = np.array([len(w) for w in words])
        self.word_at = np.concatenate([[0], np.cumsum(self.words_n)])[:-1]
        self.paths_n = np.array([len(b.path) for b in rows])
        self.numbers = np.array([_numbers(b, i, len(p)) for p in pages for i, b in enumerate(p)], np.float32).reshape(-1, NUMBERS)
        self.time = np.concatenate([np.arange(len(p)) for p in pages])
        self.page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        self.shape = (max(len(p) for p in pages), len(pages))
        self.mask = np.zeros((*self.shape, 1), np.float32)
        self.mask[self.time, self.page] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic output; all weights in ``w``."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        h = HIDDEN_UNITS
        self.w = {"path": normal(PATHS, WIDTH, scale=0.1), "word": normal(WORDS, WIDTH, scale=0.02),
                  "number": normal(NUMBERS, WIDTH, scale=0.2), "bias": np.zeros(WIDTH, np.float32),
                  "out": normal(2 * h + WIDTH, 1, scale=0.2), "out_bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"{d}x": normal(WIDTH, 4 * h, scale=WIDTH**-0.5), f"{d}h": normal(h, 4 * h, scale=h**-0.5),
                       f"{d}b": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, saved: list | None) -> np.ndarray:
        """Hidden states (time, page, unit) in one direction."""
        n, pages, _ = x.shape
        size = HIDDEN_UNITS
        gates = x @ self.w[f"{d}x"] + self.w[f"{d}b"]
        h = c = np.zeros((pages, size), np.float32)
        out = np.empty((n, pages, size), np.float32)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = gates[t] + h @ self.w[f"{d}h"]
            s = _sigmoid(z[:, : 3 * size])
            i, f, o, g = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :], np.tanh(z[:, 3 * size :])
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if saved is not None:
                saved.append((t, h, c, i, f, o, g, tanh_c))
            m = mask[t]
            h, c = m * (o * tanh_c) + (1 - m) * h, m * new_c + (1 - m) * c
            out[t] = h
        return out

    def forward(self, batch: Batch, saved: dict | None = None) -> np.ndarray:
        """Logits of the batch's blocks."""
        w = self.w
        paths = np.add.reduceat(w["path"][batch.paths], batch.path_at, axis=0) / np.sqrt(batch.paths_n)[:, None].astype(np.float32)
        words = np.add.reduceat(w["word"][batch.words], batch.word_at, axis=0) / np.sqrt(batch.words_n)[:, None].astype(np.float32)
        flat = np.tanh(paths + words + batch.numbers @ w["number"] + w["bias"])
        x = np.zeros((*batch.shape, WIDTH), np.float32)
        x[batch.time, batch.page] = flat
        steps = {d: [] for d in "fb"} if saved is not None else {"f": None, "b": None}
        both = [self._pass(x, batch.mask, d, steps[d])[batch.time, batch.page] for d in "fb"]
        y = np.concatenate([*both, flat], axis=1)
        if saved is not None:
            saved |= {"flat": flat, "x": x, "steps": steps, "y": y}
        return (y @ w["out"] + w["out_bias"])[:, 0]

    def gradients(self, batch: Batch, target: np.ndarray, weight: np.ndarray) -> dict:
        saved: dict = {}
        z = self.forward(batch, saved)
        dz = ((_sigmoid(z) - target) * weight / max(1.0, weight.sum()))[:, None].astype(np.float32)
        w, size = self.w, HIDDEN_UNITS
        g = {"out": saved["y"].T @ dz, "out_bias": dz.sum(axis=0)}
        dy = dz @ w["out"].T
        dflat, dx = dy[:, 2 * size :].copy(), np.zeros_like(saved["x"])
        for k, d in enumerate("fb"):
            up = np.zeros((*batch.shape, size), np.float32)
            up[batch.time, batch.page] = dy[:, k * size : (k + 1) * size]
            dh = dc = np.zeros((batch.shape[1], size), np.float32)
            g |= {f"{d}h": np.zeros_like(w[f"{d}h"])}
            dgates = np.zeros((*batch.shape, 4 * size), np.float32)
            for t, h, c, i, f, o, gg, tanh_c in reversed(saved["steps"][d]):
                m = batch.mask[t]
                dh = dh + up[t]
                own = m * dh
                dct = m * dc + own * o * (1 - tanh_c**2)
                dzt = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), own * tanh_c * o * (1 - o), dct * i * (1 - gg**2)], axis=1)
                dgates[t] = dzt
                g[f"{d}h"] += h.T @ dzt
                dh, dc = (1 - m) * dh + dzt @ w[f"{d}h"].T, (1 - m) * dc + dct * f
            g |= {f"{d}x": np.tensordot(saved["x"], dgates, axes=([0, 1], [0, 1])), f"{d}b": dgates.sum(axis=(0, 1))}
            dx += dgates @ w[f"{d}x"].T
        dpre = (dflat + dx[batch.time, batch.page]) * (1 - saved["flat"] ** 2)
        g |= {"number": batch.numbers.T @ dpre, "bias": dpre.sum(axis=0)}
        for name, ids, n in (("path", batch.paths, batch.paths_n), ("word", batch.words, batch.words_n)):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], ids, np.repeat(dpre / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
        return g

    def train(self, pages: list[list[Block]], rounds: int = ROUNDS, seed: int = 7) -> Labeller:
        """Adam over batches of pages of like length; blocks without label give context only."""
        rng = random.Random(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        cache: dict = {}
        pages = sorted((p[:FIT_BLOCKS] for p in pages if p), key=len)
        batches = []
        for k in range(0, len(pages), BATCH):
            part = pages[k : k + BATCH]
            labels = [b.label for p in part for b in p]
            batches.append((Batch(part, cache), np.array([x or 0 for x in labels], np.float32), np.array([x is not None for x in labels], np.float32)))
        step, total = 0, max(1, rounds * len(batches))
        for _ in range(rounds):
            rng.shuffle(batches)
            for batch, target, weight in batches:
                step += 1
                rate = RATE * (1 - step / (total + 1)) + 1e-4
                for name, g in self.gradients(batch, target, weight).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    self.w[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], cache: dict) -> list[np.ndarray]:
        """Whether each block of each page is article; pages of like length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start + 1) * len(pages[order[end]]) <= CELLS:
                end += 1
            part = order[start:end]
            z = self.forward(Batch([pages[k] for k in part], cache)) > 0
            at = 0
            for k in part:
                out[k] = z[at : at + len(pages[k])]
                at += len(pages[k])
            start = end
        return out


# ---- composed pages

# Containers and wordings that pages commonly have.
CONTAINERS = {
    "article": ["article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"',
                'section class="story"', 'div id="main-content"', 'div class="post-body"', 'div role="main"', 'div class="text"', "td"],
    "header": ["header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div class="top-bar"'],
    "menu": ["nav", 'ul class="menu"', 'div id="nav"', 'div class="navbar"', 'nav class="main-nav"', 'div class="breadcrumbs"', 'ul class="links"'],
    "side": ["aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'section class="related"', 'div class="recommended"'],
    "notice": ['div class="cookie-banner"', 'div id="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div class="consent"', "dialog", 'div class="popup"'],
    "ad": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="banner-ad"'],
    "form": ["form", 'form class="search"', 'div class="newsletter"', 'div class="subscribe"', 'form id="login"', 'div class="signup"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="discussion"', 'div class="replies"'],
    "footer": ["footer", 'div id="footer"', 'div class="site-footer"', 'div class="copyright"', 'div class="bottom"'],
}
WORDINGS = {
    "header": ["Daily News", "The Journal", "My Blog", "Welcome", "Your source for news", "Log in", "Sign up"],
    "menu": ["Home", "About", "Contact", "News", "Sports", "Blog", "Shop", "Products", "Services", "Archive", "Login", "Help", "FAQ", "Privacy"],
    "side": ["Related articles", "Recent posts", "Popular now", "Categories", "Tags", "Follow us", "You may also like", "Most read"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "By using this site you agree to our terms.", "This site uses cookies.", "Please enable JavaScript."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50%", "Limited offer", "Click here", "Shop the sale"],
    "form": ["Subscribe to our newsletter", "Email address", "Search", "Submit", "Password", "Remember me"],
    "comments": ["Comments", "Reply", "Leave a comment", "3 comments", "Report", "says:", "Great post, thanks!"],
    "footer": ["© 2024 All rights reserved", "Privacy policy", "Terms of use", "Contact us", "Powered by a blog", "Back to top"],
}


def composed_page(rng: random.Random, texts: list[str], mains: list[str]) -> str:
    """A page of random layout over given texts; its containers carry their label in the markup."""
    def words(most: int) -> str:
        some = rng.choice(texts).split()
        at = rng.randrange(len(some))
        return " ".join(some[at : at + rng.randint(1, most)])

    def escaped(text: str) -> str:
        return html.escape(text, quote=False)

    def box(kind: str, inner: str) -> str:
        # a container without telling name now and then, so that order and texts count too
        opening = rng.choice(CONTAINERS[kind]) if rng.random() < 0.95 else f'div class="c{rng.randrange(50)}"'
        return f'<{opening} data-label="{int(kind == "article")}">{inner}</{opening.split()[0]}>'

    def sentence(kind: str) -> str:
        return escaped(rng.choice(WORDINGS[kind]) if rng.random() < 0.6 else words(12))

    def items(kind: str, most: int) -> str:
        return "".join(f'<li><a href="#">{sentence(kind)}</a></li>' for _ in range(rng.randint(1, most)))

    def paragraph(text: str, closed: bool) -> str:
        t = escaped(text)
        if rng.random() < 0.2 and " " in t and "&" not in t:
            a, b = t.split(" ", 1)
            t = rng.choice([f'<a href="#">{a}</a> {b}', f"<b>{a}</b> {b}", f"<b>{a}<br> {b}"])
        return f"<p>{t}</p>" if closed else f"<p>{t}"

    def plain(kind: str) -> str:
        return rng.choice([f"<p>{sentence(kind)}</p>", sentence(kind), f"<span>{sentence(kind)}</span>", f"<h3>{sentence(kind)}</h3><ul>{items(kind, 4)}</ul>"])

    def article() -> str:
        out, closed = [], rng.random() < 0.7
        if rng.random() < 0.7:
            out.append(f"<h1>{escaped(words(10))}</h1>")
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
            # any wording may also be part of an article
            main, dice = rng.choice(mains if rng.random() < 0.85 else rng.choice(list(WORDINGS.values()))), rng.random()
            if dice < 0.72:
                out.append(paragraph(main if rng.random() < 0.85 else words(6), closed))
            elif dice < 0.78:
                out.append(f"<h{rng.randint(2, 4)}>{escaped(words(8))}</h2>")
            elif dice < 0.84:
                out.append("<ul>" + "".join(f"<li>{escaped(words(14))}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif dice < 0.88:
                out.append(f"<blockquote>{escaped(main)}</blockquote>")
            elif dice < 0.91:
                out.append(f"<table><tr><td>{escaped(words(4))}</td><td>{escaped(words(4))}</td></tr></table>")
            elif dice < 0.94:
                out.append(f"<pre>{escaped(words(20))}</pre>")
            else:
                kind = rng.choice(["ad", "side", "form", "notice"])
                out.append(box(kind, plain(kind)))
        if rng.random() < 0.1:
            out.append(comments())
        return "".join(out)

    def comments() -> str:
        head = f"<h{rng.randint(2, 4)}>{sentence('comments')}</h2>" if rng.random() < 0.6 else ""
        return box("comments", head + "".join(f"<div><b>{escaped(words(2))}</b> <p>{escaped(rng.choice(mains) if rng.random() < 0.7 else words(9))}</p></div>"
                                       for _ in range(rng.randint(1, 5))))

    def maybe(kind: str, chance: float) -> str:
        if rng.random() > chance:
            return ""
        if kind == "menu":
            return box("menu", f"<ul>{items('menu', 9)}</ul>")
        if kind == "footer":
            mark = rng.choice(["&copy; ", ""])
            return box("footer", mark + sentence("footer") + rng.choice(["", " &middot; " + escaped(words(15)), "<p>" + sentence("footer") + "</p>"]))
        return box(kind, "".join(plain(kind) for _ in range(rng.randint(1, 3))))

    side = maybe("side", 0.4)
    parts = [maybe("notice", 0.2), maybe("header", 0.5), maybe("menu", 0.7), maybe("ad", 0.4), side if rng.random() < 0.5 else "", maybe("form", 0.15),
             box("article", article()), "" if rng.random() < 0.5 else side, comments() if rng.random() < 0.3 else "", maybe("ad", 0.2), maybe("footer", 0.8), maybe("notice", 0.1)]
    if rng.random() < 0.08:  # a page of nothing else
        parts = [box("article", article() or f"<p>{escaped(words(3))}</p>")]
    return f"<html><head><title>{escaped(words(8))}</title></head><body>{''.join(parts)}</body></html>"


def fit(pages: DataFrame, html_col: str = "html") -> Labeller:
    """The network, trained on at most FIT_PAGES pages (by hash order, their first FIT_CHARS characters) and COMPOSED composed ones.

    Only the fit is bounded; every page is labelled whole. Pages whose markup names no article lend their
    texts only. Without any text, composed pages consist of common wordings.
    """
    text = text_or_empty(html_col)
    rows = (pages.select(F.substring(text, 1, FIT_CHARS).alias("page"), F.xxhash64(text).alias("h")).where("page <> ''")
            .orderBy("h", "page").limit(FIT_PAGES).toArrow()["page"].to_pylist())
    names, rng = Names(), random.Random(11)
    read = [blocks_of(r, names, markup_label) for r in rows]
    told = [p for p in read if any(b.label == 1 for b in p)]
    wordings = [w for some in WORDINGS.values() for w in some]
    texts = [b.text for p in read for b in p] or wordings
    mains = [b.text for p in told for b in p if b.label == 1] or sorted(texts, key=len)[-max(1, len(texts) // 4) :]
    made = [blocks_of(composed_page(rng, texts, mains), names) for _ in range(COMPOSED)]
    return Labeller().train(2 * told + made)


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """(row, text, blocks): the input's rows, the text of their article blocks, one a line, and those blocks' numbers.

    Null and empty pages, pages without text and pages without article have an empty text. Blocks are numbered over
    all blocks of the page that have text. Rows are taken one by one: repeated rows get the same text each, other
    columns stay inside ``row``. Pages are read whole; a page's memory follows its own length.
    """
    given = pages.sparkSession.sparkContext.broadcast(model)

    def make():
        own, names, cache = given.value, Names(), {}

        def columns(texts):
            read = [blocks_of(t, names) for t in texts]
            marked = own.label(read, cache)
            chosen = [np.flatnonzero(m).tolist() for m in marked]
            return [["\n".join([p[k].text for k in c]) for p, c in zip(read, chosen, strict=True)], chosen]
        return columns

    return with_columns(pages, html_col, "text string, blocks array<int>", make, SLICE)
