"""Extraction: hand-labelled pages, broken markup, exact inference."""
import html
import itertools
import re

import pandas as pd

from ledgerlens.llm import html_tree as H

from ..conftest import SF_SMALL


def _model(spark):
    return H.train(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).prepared()


def test_pages_of_the_table(spark):
    pages = pd.read_parquet(f"{SF_SMALL}/pages.parquet")
    got = H.main_text(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).toPandas().set_index("page_id")
    for i, page in zip(pages.page_id, pages.html):
        body = re.sub(r"<[^<>]*$", "", re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1])
        parts = re.split(r"</?(?:p|h1)>", body)
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in parts]
        assert got.text[i] == "\n\n".join(b for b in want if b)
        assert got.n_chars[i] == len(got.text[i])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
<header id="masthead"><h2>Daily</h2></header><nav class="main-menu"><ul><li><a href="/">Home</a><li><a href="/n">News</a></ul></nav>
<div class="cookie-banner"><p>We use cookies</p></div>
<main><article class="post"><h1>Title &amp; more&nbsp;&#8212; x</h1><p>First <a href="/l">linked</a>
   words<p>Second<br>line</p><ul><li>one<li>two</ul><div class="advert"><p>Buy!</p></div><table><tr><td>c1<td>c2</table>
<form><label>Vote</label><input></form><blockquote>Quote</blockquote><!-- <p>hidden</p> --><noscript>js</noscript>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>Nice &lt;b&gt;</p></div></section></article></main>
<aside class="sidebar"><h3>Popular</h3><p>Side text</p></aside><footer><p>&copy; us</p></footer></body></html>"""


def test_layout_with_everything(spark):
    want = ["Title & more — x", "First linked words", "Second line", "one", "two", "c1", "c2", "Quote"]
    assert H.extract(PAGE, _model(spark)).split("\n\n") == want


def test_layout_without_an_article(spark):
    page = """<body><div id="header"><a href="/">Site</a></div><div id="content"><h1>Head</h1><p>Alpha.</p><p>Beta.</p>
    <div class="share-buttons"><a href="#">Share</a></div></div><div class="sidebar"><p>Tags</p></div><div id="comments"><p>me too</p></div>
    <div id="footer"><p>Imprint</p></div></body>"""
    assert H.extract(page, _model(spark)).split("\n\n") == ["Head", "Alpha.", "Beta."]


def test_broken_markup(spark):
    pot = _model(spark)
    assert H.extract("<article><p>a</b></i></div><p>b &am", pot) == "a\n\nb &am"
    assert H.extract("<article><p>a<scr", pot) == "a"
    assert H.extract("<article><p>1 < 2 and 3<4</p><!-- never closed <p>x", pot).startswith("1 < 2 and 3<4")
    assert H.extract("<article><p>a</p><script>var a = 1;", pot) == "a"
    assert H.extract(None, pot) == H.extract("", pot) == ""


def test_marginals_are_exact(spark):
    """Sum-product equals the sum over all states on a small tree."""
    pot = _model(spark)
    nodes = H.parse("<article><p>a<b>c</b></p><div class='ad'>x</div></article><nav><a>y</a></nav>")
    H._measure(nodes)
    got = H.marginals(nodes, pot)
    n = len(nodes)
    total, on = 0.0, [0.0] * n
    for s in itertools.product((0, 1), repeat=n):
        w = 0.05 if s[0] else 1.0
        for i in range(1, n):
            t00, t01, t10, t11 = pot.edge[H._kind(nodes[i])]
            w *= ((t00, t01), (t10, t11))[s[nodes[i].parent]][s[i]] * (pot.node(H._features(nodes[i])) if s[i] else 1.0)
        total += w
        for i in range(n):
            on[i] += w * s[i]
    assert all(abs(g - o / total) < 1e-9 for g, o in zip(got, on))


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>" + "z " * 50_000, "x")],
                               "page_id long, url string, html string, text string")
    got = H.main_text(df).toPandas()
    assert len(got) == 5 and got[got.page_id == 2].text.tolist() == [""] and got[got.page_id == 1].text.nunique() == 1
    assert (got.n_chars == got.text.map(len)).all()
    assert H.main_text(df.limit(0)).count() == 0
