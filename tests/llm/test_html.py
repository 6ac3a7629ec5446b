"""Main text of pages: parsing, exact marginals, held-out accuracy, and the pages of the table against their articles."""

from __future__ import annotations

import itertools
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"
ARTICLE = "<h1>Title of it</h1><p>Some words here, of the article. More of them.</p><p>On.</p><p>Another one, with some more words in it. And then more.</p>"
TEXT = "Title of it\nSome words here, of the article. More of them.\nOn.\nAnother one, with some more words in it. And then more."


@pytest.fixture(scope="module")
def model(spark):
    from glyphmill.llm.htmlextract import learn_main_text

    return learn_main_text(spark.read.parquet(f"{SMALL}/pages.parquet"))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<b>b</b> c<br>d<p>e &amp; f&nbsp;g<script>x<p></script>h", "ab c d\ne & f gh"),
        ("<table><tr><td>a<td>b<tr><td>c</table>x", "a\nb\nc\nx"),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "a\nb\nc\nd"),
        ("<div>a<span class=x>b</span>c</div></div>d<!-- x --> e <", "abc\nd e <"),
        ('<a href="x>y">t</a> 1<2 a < b <b', "t 1<2 a < b"),
        ("<head><title>t</title><p>x", "x"), ("<textarea>zzz", ""), ("", ""), (" \n ", ""), ("<p></p>", ""), ("&lt;p&gt; &eacute;&#233;&#xe9;&am &amp", "<p> ééé&am &"),
        ("<p>a<style>p{}</style>b<!-- <p>no</p> -->c</P>d", "abc\nd"), ("x<select><option>a</select>y<button>z</button>w", "x\nyw"),
        ("<pre>a\n  b</pre>\n\n<p>\tc\xa0 d </p>", "a b\nc d"), ("<svg><text>no</text></svg>yes<noscript>no</noscript>", "yes"), ("<p title='a>b'>c</p><p title=\"open>d", "c\nd"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"),
    ],
)
def test_blocks(source, text):
    from glyphmill.llm.htmltree import Page

    page = Page(source)
    assert page.text([True] * len(page.full)) == text


def test_marginals_are_exact():
    from glyphmill.llm.htmlextract import Forest, marginals

    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        parent = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        kind, own, edge = rng.integers(0, 5, n), rng.normal(0, 2, n), rng.normal(0, 2, (5, 2, 2))
        forest = Forest(np.array(parent), kind, np.zeros(0, int), np.zeros(0, int))
        p, pair = marginals(forest, own, edge, pairs=True)
        total, one, two = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(own[i] * y[i] for i in range(n)) + sum(edge[kind[i], y[parent[i]], y[i]] for i in range(1, n)))
            total += w
            one += w * np.array(y)
            for i in range(1, n):
                two[i, y[parent[i]], y[i]] += w
        assert np.allclose(p, one / total) and np.allclose(pair, two / total)


def test_training_climbs_the_likelihood():
    """At the optimum the expected counts are the labels' counts, less what the penalty takes."""
    from glyphmill.llm import htmlextract as h

    rng = np.random.default_rng(1)
    parent = np.array([-1 if i % 10 == 0 else i - 1 - int(rng.integers(0, i % 10)) for i in range(400)])
    label = rng.integers(0, 2, 400)
    place = label * (rng.random(400) < 0.8) + 2 * rng.integers(0, 2, 400)
    forest = h.Forest(parent, rng.integers(0, 5, 400), np.arange(400), place)
    model = h.train(forest, label)
    p, _ = h.marginals(forest, model.weight[place], model.edge, pairs=True)
    gap = np.bincount(place, label - p, 4) - h.DECAY * model.weight[:4]
    assert np.abs(gap).max() < 2 and ((p > 0.5) == label).mean() > 0.75


def test_held_out_layouts(model):
    from glyphmill.llm.htmlextract import main_texts
    from glyphmill.llm.htmllayouts import layout
    from glyphmill.llm.htmltree import Page, encode, marks

    sources = [layout(i) for i in range(10**6, 10**6 + 300)]
    want = []
    for s in sources:
        page = Page(s)
        y = marks(page)
        assert len(y) == len(encode(page)[0])
        want.append(page.text([bool(v) for v in y[len(y) - len(page.full) :]]))
    assert np.mean([a == b for a, b in zip(main_texts(sources, model), want, strict=True)]) > 0.9


CASES = {
    "landmarks": f"<body><header><h1>My site</h1><p>The best of sites</p></header><nav><ul><li><a href=x>a</a></ul></nav><article>{ARTICLE}</article><aside><h3>Related</h3><ul><li><a href=x>One thing</a></li></ul></aside><footer>x</footer>",
    "notice": f'<body><div class="cookie-banner"><p>We use cookies on this site to make it better for you.</p><button>OK</button></div><article>{ARTICLE}</article>',
    "comments": f'<body><article>{ARTICLE}</article><section class="comments"><h2>Comments</h2><div class="comment"><p>I like this very much, it is a great article. Thanks for it, and see you soon.</p></div></section>',
    "comment articles": f'<body><article>{ARTICLE}</article><div id="comments"><article><p>I like this very much, it is a great article. Thanks for it.</p></article><form><label>Name</label><textarea></textarea></form></div>',
    "comments inside": f'<body><article>{ARTICLE}<div class="comments"><p>anna: I like this very much, it is a great article.</p><p>Thanks for it.</p></div></article>',
    "sidebar": f'<body><div class="sidebar"><p>About the author: this person writes many things about many other things.</p></div><div class="content">{ARTICLE}</div>',
    "advert inside": f"<body><article>{ARTICLE.replace('<p>On.', '<div class=ad>Buy our very good things now, at low prices.</div><p>On.')}</article>",
    "form": f"<body><article>{ARTICLE}</article><form action=x><p>Subscribe to our newsletter, it is very good.</p><input name=a></form>",
    "without names": f"<body><div><a href=a>Home</a> | <a href=b>News</a></div><div>{ARTICLE}</div><div>Copyright 2020 by us</div>",
    "hidden": f'<body><div style="display: none" class="popup"><p>Sign up now for more of this, every week.</p></div><div id="article-body">{ARTICLE}</div>',
}


@pytest.mark.parametrize("name", CASES)
def test_made_by_hand(model, name):
    from glyphmill.llm.htmlextract import main_texts

    assert main_texts([CASES[name]], model) == [TEXT]


class InArticle(HTMLParser):
    """The article's blocks, by the library's parser and the structure of the table's pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p", "article"):
            self.blocks.append("")
        elif tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("h1", "p", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def brute_text(source):
    parser = InArticle()
    parser.feed(source)
    parser.close()
    return "\n".join(" ".join(b.split()) for b in parser.blocks if b.split())


def test_pages_of_the_table(spark, model):
    from glyphmill.llm.htmlextract import extract_main_text

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages, model).collect()}
    want = {r["page_id"]: brute_text(r["html"]) for r in pages.collect()}
    assert len(got) == len(want) and [i for i in want if got[i] != want[i]] == []


def test_query(spark):
    from glyphmill.llm.queries import op11_html_text

    rows = op11_html_text(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and rows[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


def test_edge_pages(spark, model):
    from glyphmill.llm.htmlextract import extract_main_text, main_text

    long = f"<body><nav><a href=x>Home</a></nav><article>{'<p>Some words here, of the article. More of them.</p>' * 20_000}</article>"
    deep = "<div>" * 3000 + "<p>Some words here, of the article. More of them.</p>"
    rows = [(1, None), (2, ""), (3, " "), (4, "<nav><a href=x>Home</a></nav>"), (5, CASES["notice"]), (5, CASES["notice"]), (None, CASES["notice"]), (6, long), (7, deep), (8, "&#xd800; \x00 <a")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).withColumn("n_chars", F.lit(1)).withColumn("__html", F.lit("x"))
    got = extract_main_text(df, model).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"page_id", "url", "n_chars", "__html", "text"}
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r["text"])
    assert by[1] == by[2] == by[3] == by[4] == [""] and by[5] == [TEXT, TEXT] and by[None] == [TEXT] and by[6][0].count("\n") == 19_999 and by[7] == ["Some words here, of the article. More of them."]
    assert main_text(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="text"):
        extract_main_text(df.withColumn("text", F.lit("x")), model)
