"""The page model: exact marginals, pages of all sorts, and held-out layouts."""

import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from leafmill.llm import extraction
from leafmill.llm.dom import TEXT, parse

from test_llm import SMALL


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        parent = np.array([-1, *(rng.integers(0, x) for x in range(1, n))])
        depth = np.zeros(n, int)
        for x in range(1, n):
            depth[x] = depth[parent[x]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        kind, unary, pair = rng.integers(0, 4, n), rng.normal(0, 2, n), rng.normal(0, 2, (4, 2, 2))
        batch = extraction.Batch(parent, levels, kind, np.zeros(0, int), np.zeros(0, int))
        belief, joint = extraction.beliefs(batch, unary, pair)
        total, each, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(unary[x] * y[x] + (pair[kind[x], y[parent[x]], y[x]] if x else 0) for x in range(n)))
            total += p
            each += p * np.array(y)
            for x in range(1, n):
                pairs[x, y[parent[x]], y[x]] += p
        assert np.allclose(1 / (1 + np.exp(-belief)), each / total)
        assert np.allclose(joint[1:], pairs[1:] / total)


def stretches(html):
    return [(p.tag[p.parent[x]], p.text[x]) for p in [parse(html)] for x in range(len(p.tag)) if p.tag[x] == TEXT]


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>a<p>b<b>c</b> d<br>e</p>f", [("p", "a"), ("p", "bc d e"), ("#page", "f")]),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", [("li", "1"), ("li", "2"), ("li", "3")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", [("td", "a"), ("td", "b"), ("th", "c"), ("#page", "d")]),
        ("<script>var a='<p>x</p>';</script>a<!-- <p>b --> c<style>p{}</style><textarea><b>t</textarea>", [("#page", "a c")]),
        ("a &lt;b&gt; &amp;amp; &eacute;&#x4e2d;&nbsp;&#128512; < 3 <3", [("#page", "a <b> &amp; é中 😀 < 3 <3")]),
        ("<div title='a>b' class=x>in</div ><p>open <a href='", [("div", "in"), ("p", "open")]),
        ("<script>never closed <p>x", []),
        ("a<!-- never closed <p>x", [("#page", "a")]),
        ("<P>A</P></p></div>B</body>C</html>", [("p", "A"), ("#page", "B"), ("#page", "C")]),
        ("<dl><dt>t<dd>d<dt>u</dl><select><option>1<option>2</select>", [("dt", "t"), ("dd", "d"), ("dt", "u"), ("option", "1"), ("option", "2")]),
        ("", []),
        (None, []),
    ],
)
def test_tree(html, wanted):
    assert stretches(html) == wanted


def test_links_are_counted():
    page = parse("<p>ab <a>cdef</a> gh</p><p><a>ij<p>kl</p>")
    assert [(t, n) for t, n in zip(page.text, page.linked, strict=True) if t] == [("ab cdef gh", 4), ("ij", 2), ("kl", 0)]


@pytest.fixture(scope="module")
def model():
    html = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if r["page_id"] % 3]
    return extraction.fit(extraction.training_pages(html[:100], 5))


def test_held_out_layouts(model):
    html = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist() if not r["page_id"] % 3]
    held = extraction.training_pages(html, 3)
    found = model.marginals(extraction.Batch.of([p for p, _ in held])) >= 0.5
    label = np.concatenate([k for _, k in held])
    text = np.array([t == TEXT for p, _ in held for t in p.tag])
    assert (found == label)[text].mean() > 0.985
    assert found[text & label].mean() > 0.97 and found[text & ~label].mean() < 0.015


SHOP = """<!doctype html><html><head><title>T - Site</title></head><body class="home"><div class="cookie-banner"><p>We use
cookies to improve your experience. By continuing you accept them.</p><button>Accept</button></div>
<header class="site-header"><a href="/">Site Name</a><p>Just another blog about things.</p></header>
<nav class="main-menu"><ul><li><a href=/>Home</a><li><a href=/about>About us</a></ul></nav>
<div id="wrapper"><div class="content"><h1>The big title</h1><p>First paragraph of the story, which is fairly long and has
<a href=x>one link</a> in it. It goes on.</p><p>Short one.</p><div class="advert">Buy our product now! It is cheap.</div>
<ul><li>Point one of the list</li><li>Point two</li></ul><blockquote>A quote, said someone.</blockquote><p>Last paragraph
ends here&nbsp;&amp; now.</p></div><aside class="sidebar"><h3>Popular</h3><ul><li><a href=a>Another story that people
read a lot</a></li><li><a>Second</a></li></ul><p>Sign up to our weekly letter, it is free of charge.</p></aside></div>
<section id="comments"><h3>3 Comments</h3><div class="comment"><b>Joe</b><p>I really enjoyed this one. Thank you for
writing it.</p></div><div class="comment"><p>Me too.</p></div></section><form class="search"><label>Search</label><input>
<button>Go</button></form><footer><p>&copy; 2024 Site Name. All rights reserved.</p></footer></body></html>"""


@pytest.mark.parametrize(
    "html, wanted",
    [
        (SHOP, "The big title\nFirst paragraph of the story, which is fairly long and has one link in it. It goes on.\nShort one.\nPoint one of the list\nPoint two\nA quote, said someone.\nLast paragraph ends here & now."),
        ("<body><div class=nav><a href=1>Home</a> | <a href=2>News</a></div><main><h1>Title</h1><p>Ok.</p><p>Fine text with some words in it.</p><form><p>Subscribe to us today.</p><input></form></main><div class=footer>Contact us at the office.</div></body>", "Title\nOk.\nFine text with some words in it."),
        ("", ""),
        (None, ""),
        ("<script>x</script>", ""),
    ],
)
def test_pages_of_other_sites(model, html, wanted):
    assert model.texts([html]) == [wanted]


def test_rows(spark, model):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, "u", SHOP, "a"), (1, "u", SHOP, "a"), (2, None, None, "b"), (None, "v", "", "c"), (3, "w", "<article><p>" + "A long text. " * 400_000, "d"), (4, "x", deep, "e"), (5, "y", "<p" * 20_000, "f"), (6, "z", '<a "' * 20_000, "g")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extracted(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[None] == "" and by[3] == ("A long text. " * 400_000).strip() and by[1] == model.texts([SHOP])[0]
    assert extraction.extracted(pages.limit(0), model).count() == 0


def test_no_sample(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    model = extraction.learn(pages)
    assert extraction.extracted(pages, model).count() == 0
    assert extraction.fit([]).texts([None, ""]) == ["", ""]
    assert random.Random(1).random() == random.Random(1).random()
