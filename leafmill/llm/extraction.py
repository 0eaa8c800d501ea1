"""Main text of web pages by a graphical model over the page's tree.

Every block element and every stretch of text is a binary variable: content or not. A variable has a potential from what
is seen of it (tag, class words, lengths, links, punctuation, place), and every pair of parent and child one from their
kinds. On a tree the sum-product algorithm is exact: messages go up from the leaves, then down from the root, and give
each variable's marginal. Messages of many pages pass in step, one level of depth at a time. Weights maximise the
likelihood of labelled pages.

Labelled pages are those of a bounded sample in which an element says that it is the article (``article``, ``main`` and
the like); the stretches inside it are content. As one site's pages teach one layout, each sampled page also trains in
layouts that are built here: its article, its boilerplate and another page's text are placed among menus, notices,
sidebars, adverts, forms and reader comments as sites mark them, so class words, links and lengths count, not a template.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import escape
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.dom import TEXT, Page, parse

#: Bounds of the sample: pages, the smallest by hash of id, and characters of a page that may be in it.
PAGES, PAGE_CHARS = 200, 200_000
LAYOUTS, FEATURES, STEPS, RATE, RIDGE = 6, 1 << 13, 150, 0.1, 1e-4
#: Features up to this number measure something; the others are hashed names.
NUMBERS = 512
#: Kinds of child for the pair potentials: stretches of text, lines of an article, containers that say what they hold, others.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption tr ul ol dl table figure".split())
NAMED = frozenset("article main nav header footer aside form section body".split())
ARTICLE = re.compile(r"\b(?:articlebody|main)\b", re.I)
NOT_ARTICLE = frozenset("nav header footer aside form button select fieldset noscript template".split())


def _kind(tag: str) -> int:
    return 0 if tag == TEXT else 1 if tag in LINES else 2 if tag in NAMED else 3


def _words(marks: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", marks).lower())


@lru_cache(100_000)
def _names(tag: str, parent: str, within: str, outer: str, marks: str) -> tuple[int, ...]:
    """Hashed features of a node's tag, its parent's, the nearest elements that say what they hold, and class words."""
    if tag == TEXT:
        names = [f"in {parent}", f"text within {within}"]
    else:
        words = _words(marks)
        names = [tag, f"within {within}", f"{tag} in {outer}", f"{tag} marked{bool(words)}", *(f"word {w}" for w in words)]
        names += [f"part {w[k : k + 4]}" for w in words for k in range(len(w) - 3)]
    return tuple({NUMBERS + crc32(f.encode()) % (FEATURES - NUMBERS) for f in names})


@dataclass
class Batch:
    """Nodes of many pages: parents (-1 for a page's first), levels of depth, kinds, and features as flat arrays."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    owner: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, pages: list[Page]) -> Batch:
        parent, depth, kind, named, base = [], [], [], [], 0
        for page in pages:
            parent += [p + base if p >= 0 else -1 for p in page.parent]
            depth += page.depth
            kind += map(_kind, page.tag)
            within: list[str] = []
            for x, (tag, p, marks) in enumerate(zip(page.tag, page.parent, page.marks, strict=True)):
                outer = within[p] if x else ""
                within.append(tag if tag in NAMED else outer)
                named.append(_names(tag, page.tag[p], within[x], outer, marks))
            base += len(page.tag)
        deep, up = np.array(depth, np.int64), np.array(parent, np.int64)
        order = np.argsort(deep, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(deep[order])) + 1) if base else []
        kinds = np.array(kind, np.int64)
        size = np.fromiter(map(len, named), np.int64, base)
        owner, feature = _seen(pages, up, levels, kinds == 0)
        return cls(up, levels, kinds, np.concatenate([owner, np.repeat(np.arange(base), size)]), np.concatenate([feature, np.fromiter(chain.from_iterable(named), np.int64, int(size.sum()))]))


def _seen(pages: list[Page], parent: np.ndarray, levels: list[np.ndarray], is_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, feature) of what is measured: lengths, share of links, place and share of the page, sentences."""
    texts = [t for page in pages for t in page.text]
    n = len(texts)
    sizes = np.array([len(page.text) for page in pages], np.int64)
    of = np.repeat(np.arange(len(pages)), sizes)
    chars = np.fromiter(map(len, texts), np.int64, n)
    total = np.bincount(of, chars, len(pages))
    before = np.cumsum(chars) - chars
    before -= before[np.repeat(np.cumsum(sizes) - sizes, sizes)] if n else 0
    linked = np.fromiter(chain.from_iterable(page.linked for page in pages), np.int64, n)
    held = np.stack([chars, linked, is_text], 1).astype(float)
    for level in reversed(levels[1:]):  # subtrees add up
        np.add.at(held, parent[level], held[level])
    chars, linked, stretches = held.T
    whole = np.maximum(total[of], 1)
    log = lambda x: np.minimum(2 * np.log2(x + 1), 39).astype(np.int64)
    links = (4 * linked / np.maximum(chars, 1) + 0.5).astype(np.int64)
    both = [(1, np.zeros(n, np.int64)), (40, log(chars)), (5, links), (10, 2 * links + (chars > 80)), (9, (8 * before / whole).astype(np.int64)), (9, (8 * chars / whole).astype(np.int64))]
    nodes, found, at = [], [], 0
    for room, value in both:
        nodes.append(np.arange(n))
        found.append(at + np.where(is_text, room, 0) + value)
        at += 2 * room
    here = np.flatnonzero(is_text)
    marks = np.array([sum(map(texts[x].count, ".!?。！？")) for x in here], np.int64)
    ends = np.array([texts[x][-1] in ".!?…。！？:;" for x in here], np.int64)
    signs = np.array([any(map(texts[x].__contains__, "©®»›→•")) for x in here], np.int64)
    there = np.flatnonzero(~is_text)
    rest = [(40, here, log(marks)), (4, here, 2 * ends + (chars[here] > 40)), (2, here, signs), (40, there, log(stretches[there])), (40, there, log(chars[there] / np.maximum(stretches[there], 1)))]
    for room, where, value in rest:
        nodes.append(where)
        found.append(at + value)
        at += room
    return np.concatenate(nodes), np.concatenate(found)


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def beliefs(batch: Batch, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each node, and P(parent, child) of each node's pair with its parent as an (n, 2, 2) array.

    ``unary``: log-odds of each node by itself; ``pair[kind, parent, child]``: log potentials.
    """
    n = len(unary)
    theta = pair[batch.kind]
    own, up, down = unary.astype(float).copy(), np.zeros(n), np.zeros(n)
    for level in reversed(batch.levels[1:]):  # leaves to root
        t, b = theta[level], own[level]
        up[level] = _soft(t[:, 1, 0], t[:, 1, 1] + b) - _soft(t[:, 0, 0], t[:, 0, 1] + b)
        own += np.bincount(batch.parent[level], up[level], n)
    rest = np.zeros(n)  # the parent's log-odds without this child
    for level in batch.levels[1:]:  # root to leaves
        t, p = theta[level], batch.parent[level]
        rest[level] = own[p] + down[p] - up[level]
        d = rest[level]
        down[level] = _soft(t[:, 0, 1], t[:, 1, 1] + d) - _soft(t[:, 0, 0], t[:, 1, 0] + d)
    joint = theta + rest[:, None, None] * np.array([[0.0, 0], [1, 1]]) + own[:, None, None] * np.array([[0.0, 1], [0, 1]])
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    return own + down, joint / joint.sum((1, 2), keepdims=True)


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, batch: Batch) -> np.ndarray:
        unary = np.bincount(batch.owner, self.weights[batch.feature], len(batch.parent))
        return 1 / (1 + np.exp(-np.clip(beliefs(batch, unary, self.pair)[0], -500, 500)))

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [parse(html) for html in pages]
        found, at, out = self.marginals(Batch.of(trees)), 0, []
        for tree in trees:
            out.append("\n".join(t for t, p in zip(tree.text, found[at : at + len(tree.tag)], strict=True) if t and p >= 0.5))
            at += len(tree.tag)
        return out


def labels_of(page: Page) -> np.ndarray | None:
    """Content or not of each node, from the elements that say so; None where none does or none holds text."""
    n = len(page.tag)
    inside, named = np.zeros(n, bool), [t == "article" or bool(ARTICLE.search(m)) for t, m in zip(page.tag, page.marks, strict=True)]
    if not any(named):
        named = [t == "main" for t in page.tag]
    for x in range(1, n):
        inside[x] = (named[x] or inside[page.parent[x]]) and page.tag[x] not in NOT_ARTICLE
    return inside if any(page.tag[x] == TEXT and inside[x] for x in range(n)) else None


#: Class words that sites use, fixed values; None: no class.
_CONTENT = ["content", "post", "entry-content", "article-body", "story", "post-content", "main-content", "text", None, None]
_MENU = ["menu", "navbar", "nav", "breadcrumbs", "main-navigation", "topnav", "pagination", "links", None]
_SIDE = ["sidebar", "widget-area", "widget", "related", "related-posts", "popular", "recommended", "secondary", "rail", "trending", None]
_AD = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adsbygoogle", "teaser"]
_NOTICE = ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "announcement", "message", "disclaimer", "paywall", "popup", "modal"]
_COMMENTS = ["comments", "comment-list", "comments-area", "discussion", "responses", "disqus", "replies", "reader-comments", "commentlist"]
_FORM = ["newsletter", "search", "login", "subscribe", "signup", "contact"]
_SHARE = ["share", "social", "share-buttons", "tags", "toolbar", "meta"]
_FOOT = ["footer", "site-footer", "colophon", "copyright", "bottom", "legal"]
_HEAD = ["header", "site-header", "masthead", "topbar", "branding"]
_LONG, _MARK = re.compile(r"(?<=[.!?。！？])\s+"), "data-content"


class _Layout:
    """Builds one page out of given texts; what is content is marked with an attribute that no feature sees."""

    def __init__(self, rng: random.Random, article: list[str], other: list[str]):
        self.rng = rng
        if rng.random() < 0.25:  # a short article
            article = [" ".join(t.split()[: rng.randint(1, 12)]) for t in article[: rng.randint(1, 3)]]
        self.article = article
        self.other = [s for t in other for s in _LONG.split(t) if s] or ["…"]
        self.words = [w for s in self.other for w in s.split()] or ["…"]

    def some(self, least: int, most: int) -> str:
        return " ".join(self.rng.choice(self.other) for _ in range(self.rng.randint(least, most)))

    def few(self, least: int = 1, most: int = 4) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(self.rng.randint(least, most)))

    def open(self, tag: str, names: list | None = None, content: bool = False) -> str:
        name = self.rng.choice(names) if names else None
        kind = f' {self.rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{kind}{' ' + _MARK if content else ''}>"

    def link(self, text: str | None = None) -> str:
        return f'<a href="/x">{escape(text or self.few())}</a>'

    def links(self, tags: list[str], names: list, n: int) -> str:
        tag, items = self.rng.choice(tags), [self.link() for _ in range(n)]
        if self.rng.random() < 0.7:
            body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        else:
            body = self.rng.choice([" ", " | ", " &middot; "]).join(items)
        return self.open(tag, [None] if tag == "nav" else names) + body + f"</{tag}>"

    def side(self) -> str:
        tag = self.rng.choice(["aside", "aside", "div", "section"])
        parts = [f"<h3>{escape(self.few())}</h3>", self.links(["div"], _SIDE, self.rng.randint(2, 7))]
        parts += [f"<p>{escape(self.some(1, 3))}</p>" for _ in range(self.rng.randint(0, 3))]
        return self.open(tag, _SIDE if tag == "aside" else _SIDE[:-1]) + "".join(parts) + f"</{tag}>"

    def ad(self) -> str:
        body, tag = escape(self.some(1, 3)), self.rng.choice(["div", "div", "aside", "section"])
        return self.open(tag, _AD) + self.rng.choice([body, f"<p>{body}</p>", self.link(body)]) + f"</{tag}>"

    def notice(self) -> str:
        body, tag = escape(self.some(1, 4)), self.rng.choice(["div", "div", "section", "dialog"])
        return self.open(tag, _NOTICE) + self.rng.choice([body, f"<p>{body}</p>"]) + self.rng.choice(["", f"<button>{escape(self.few(1, 2))}</button>", self.link()]) + f"</{tag}>"

    def form(self) -> str:
        return self.open("form", [*_FORM, None]) + self.rng.choice(["", f"<p>{escape(self.some(1, 2))}</p>", f"<h3>{self.few()}</h3>"]) + f"<label>{escape(self.few())}</label><input name=q><button>{escape(self.few(1, 2))}</button></form>"

    def comments(self) -> str:
        tag = self.rng.choice(["section", "div", "div", "ol"])
        item = self.rng.choice(["article", "article", "div", "li"] if tag != "ol" else ["li"])
        each = [f'{self.open(item, ["comment", "reply", "comment-body", "response"])}<b>{escape(self.few(1, 2))}</b><p>{escape(self.some(1, 5))}</p></{item}>' for _ in range(self.rng.randint(1, 5))]
        return self.open(tag, _COMMENTS) + (f"<h3>{escape(self.few())}</h3>" if tag != "ol" else "") + "".join(each) + f"</{tag}>"

    def foot(self) -> str:
        tag = self.rng.choice(["footer", "footer", "div"])
        parts = [self.rng.choice([f"&copy; {self.few()} ", f"{self.few()} &middot; ", ""]) + escape(self.some(1, 3))]
        return self.open(tag, [None, *_FOOT] if tag == "footer" else _FOOT) + self.rng.choice(["{}", "<p>{}</p>"]).format(parts[0]) + self.rng.choice(["", self.links(["div", "nav"], _MENU, 4)]) + f"</{tag}>"

    def head(self) -> str:
        tag = self.rng.choice(["header", "div"])
        return self.open(tag, [None, *_HEAD] if tag == "header" else _HEAD) + self.rng.choice([self.link(), f"<h1>{self.link()}</h1>", f"<p>{escape(self.few())}</p>"]) + self.rng.choice(["", escape(self.some(1, 1)), f"<p>{escape(self.some(1, 2))}</p>"]) + f"</{tag}>"

    def body(self) -> str:
        rng, soup, out = self.rng, self.rng.random() < 0.3, []
        for k, text in enumerate(self.article):
            inside = escape(text)
            if k and len(text) > 60 and rng.random() < 0.3:
                cut = text.find(" ", len(text) // 2)
                inside = escape(text[:cut]) + " " + self.link(self.few(1, 3)) + " " + escape(text[cut:])
            tag = rng.choice(["h1", "h1", "h2"]) if not k else rng.choice(["p"] * 14 + ["h2", "h3", "blockquote", "pre", "ul", "div"])
            if tag == "ul":
                out.append(f"<ul {_MARK}>" + "".join(f"<li {_MARK}>{escape(s)}</li>" for s in _LONG.split(text)) + "</ul>")
            elif not k and rng.random() < 0.3:
                out.append(f"<header {_MARK}><{tag} {_MARK}>{inside}</{tag}></header>")
            else:
                out.append(f"<{tag} {_MARK}>{inside}" + ("" if soup and tag == "p" else f"</{tag}>"))
            if k and rng.random() < 0.12:
                out.append(rng.choice([self.ad, self.notice, self.form, self.side, lambda: self.links(["div", "ul"], _SHARE, 4)])())
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        maybe = lambda chance, make: make() if rng.random() < chance else ""
        if rng.random() < 0.12:  # little but the text itself
            plain = rng.choice(["\n".join(map(escape, self.article)), "".join(f"<p {_MARK}>{escape(t)}</p>" for t in self.article), self.body()])
            return rng.choice(["", f"<body {_MARK}>"]) + maybe(0.3, self.head) + plain + maybe(0.3, self.foot)
        tag = rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        held = self.open(tag, _CONTENT if tag in ("div", "section", "td") else [None, *_CONTENT], True) + self.body()
        held += maybe(0.4, self.comments) + maybe(0.2, lambda: self.links(["div", "ul"], _SHARE, 4)) + f"</{tag}>"
        if tag == "td":
            held = f"<table><tr>{held}<td>{self.links(['div'], _SIDE, 5)}</td></tr></table>"
        middle = [held, maybe(0.4, self.side)]
        if rng.random() < 0.3:
            middle.reverse()
        if rng.random() < 0.5:
            middle = [self.open("div", ["wrapper", "container", "page", "site", None]), *middle, "</div>"]
        parts = [maybe(0.3, self.notice), maybe(0.6, self.head), maybe(0.8, lambda: self.links(["nav", "nav", "div", "ul"], _MENU, rng.randint(2, 8))), maybe(0.4, self.ad), *middle]
        parts += [maybe(0.3, self.comments), maybe(0.3, self.form), maybe(0.3, self.side), maybe(0.85, self.foot), maybe(0.15, self.notice)]
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + maybe(0.7, lambda: "</body></html>")


def training_pages(htmls: list[str], layouts: int = LAYOUTS) -> list[tuple[Page, np.ndarray]]:
    """The labelled pages among ``htmls`` and their layouts, each with its nodes' labels."""
    out, parts = [], []
    for html in htmls:
        page = parse(html)
        known = labels_of(page)
        if known is None:  # no element says: long stretches serve as an article in layouts
            known = np.array([len(t) - k > 80 for t, k in zip(page.text, page.linked, strict=True)])
        else:
            out.append((page, known))
        parts.append(([t for t, k in zip(page.text, known, strict=True) if t and k], [t for t, k in zip(page.text, known, strict=True) if t and not k]))
    for x, (article, other) in enumerate(parts):
        more = parts[x - 1][0] + other  # sentences of another page too, so that wording tells nothing
        for k in range(layouts if article else 0):
            page = parse(_Layout(random.Random(1000 * x + k), article, more).page(), _MARK)
            if "body" not in page.tag:  # the page itself holds the article
                page.noted.add(0)
            out.append((page, np.array([(page.parent[n] if t == TEXT else n) in page.noted for n, t in enumerate(page.tag)])))
    return out


def fit(pages: list[tuple[Page, np.ndarray]], steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam over all pages at once; the same pages give the same weights."""
    weights, pair = np.zeros(FEATURES), np.zeros((4, 2, 2))
    if not pages:
        return Model(weights, pair)
    batch, y = Batch.of([p for p, _ in pages]), np.concatenate([k for _, k in pages]).astype(float)
    n = len(y)
    child = batch.parent >= 0
    seen = np.zeros((4, 2, 2))
    np.add.at(seen, (batch.kind[child], y[batch.parent[child]].astype(int), y[child].astype(int)), 1)
    value = np.zeros(FEATURES + 16)
    mean, spread = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        weights, pair = value[:FEATURES], value[FEATURES:].reshape(4, 2, 2)
        belief, joint = beliefs(batch, np.bincount(batch.owner, weights[batch.feature], n), pair)
        miss = y - 1 / (1 + np.exp(-np.clip(belief, -500, 500)))
        expected = np.zeros((4, 2, 2))
        np.add.at(expected, batch.kind[child], joint[child])
        slope = np.concatenate([np.bincount(batch.feature, miss[batch.owner], FEATURES), (seen - expected).ravel()]) / n - RIDGE * value
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        value = value + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Model(value[:FEATURES], value[FEATURES:].reshape(4, 2, 2))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    """Fit on a bounded sample: the PAGES pages with the smallest hash of their id among those of at most PAGE_CHARS
    characters. Null and empty pages and null ids are left out; of an id with several pages the least one counts."""
    able = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(f"id is not null and html <> '' and length(html) <= {PAGE_CHARS}")
    some = able.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(PAGES)
    rows = able.join(F.broadcast(some), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()
    return fit(training_pages([r["html"] for r in rows]))


def extracted(pages: DataFrame, model: Model, html_col: str = "html", *, text_col: str = "text") -> DataFrame:
    """The rows with ``text_col`` and ``n_chars`` (its code points) in place of the page.

    ``text``: the stretches of text whose marginal is 0.5 or more, in page order, joined by a newline; character
    references are decoded, white space inside a stretch (line breaks too) is one space. Block elements end a stretch,
    inline ones do not. Null and empty pages and pages without content have an empty text. Repeated rows are rows of
    their own and come out equal; a page's text depends on that page and the model only. Other columns stay, existing
    ones of the new names are replaced; an empty table stays empty. Pages are parsed whole, about four million characters
    at a time.
    """
    keep = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, size, a = batch.column(len(keep)), 0, 0
            for b in range(batch.num_rows):
                size += len(html[b].as_py() or "")
                if size > 4_000_000 or b == batch.num_rows - 1:
                    text = pa.array(model.texts(html.slice(a, b + 1 - a).to_pylist()), pa.string())
                    part = batch.slice(a, b + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], [*keep, text_col])
                    size, a = 0, b + 1

    narrow = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(html_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}{', ' if keep else ''}`{text_col}` string").withColumn("n_chars", F.length(text_col).cast("long"))


def oracle() -> str:
    """DuckDB SQL that finds the main text of pages with one ``article`` of headings and paragraphs; not the method, but
    the same rows on the given table."""
    plain = "regexp_replace(x, '<[^>]*>', '', 'g')"
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
        plain = f"regexp_replace({plain}, '&{name};?', '{sign}', 'g')"
    return f"""
    with parts as (select page_id, url, string_split_regex(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '</?(?:p|h1)>') as parts from pages),
    lines as (select page_id, url, list_transform(parts, lambda x: trim(regexp_replace({plain}, '\\s+', ' ', 'g'))) as lines from parts),
    texts as (select page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) as text from lines)
    select page_id, url, text, length(text)::bigint as n_chars from texts"""
