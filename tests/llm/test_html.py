"""HTML extraction: blocks, the network, whole pages of several shapes."""

import html as H
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import common as C
from caseflow.llm import html_lstm as X
from caseflow.llm import queries as Q
from caseflow.llm.html_blocks import blocks
from tests.conftest import SF01


def texts(page):
    return [b[1] for b in blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<p>d<br>e</p>f") == ["a b c", "d e", "f"]
    assert texts("<p>x &amp; y &lt;z&gt; &eacute;&#33;&nbsp;w") == ["x & y <z> é! w"]
    assert texts("a<!-- <p>no</p> -->b<script>if (a<b) '</p>'</script>c<style>p{}</style>") == ["abc"]
    assert texts("<div title='a>b'>x</div><DIV>y</DIV>") == ["x", "y"]
    assert texts("1 < 2 <p>3 > 2</p><") == ["1 < 2", "3 > 2", "<"]
    assert texts("<script>never closed <p>x") == [] and texts("<!-- open") == [] and texts("") == [] and texts(None) == []
    assert texts('<p class="open>x</p>') in ([], ["x"])
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    path = {b[1]: b[0] for b in blocks('<body><div class="sideBar left"><p>x<div id=main>y</div></div><p>z')}
    assert path == {"x": ("body", "div.side.bar.left", "p"), "y": ("body", "div.side.bar.left", "div.main"), "z": ("body", "p")}
    assert [b[2] for b in blocks('<p><a href="/">ab</a> cd</p>')] == [2]


def test_blocks_of_a_long_page_take_linear_time():
    import time
    def took(n):
        t = time.perf_counter()
        blocks("<p class=\"x" + "<p>word\n" * n)
        assert len(blocks("<div><p>a<b>c" * n)) == n
        return time.perf_counter() - t
    took(100)
    assert took(20_000) < 40 * took(2_000) + 1


def test_text_of_formulas_objects_and_graphics_is_kept():
    formula = "<math display=inline><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow></math>"
    assert texts(f"<article><p>We know {formula} well.</p><p>b</p></article>") == ["We know E=mc2 well.", "b"]
    assert [b[:2] for b in blocks("<article><object data=x><param name=a><p>Fallback.</p></object><p>b</p></article>")] == [
        (("article", "p"), "Fallback."), (("article", "p"), "b")]
    assert texts("<p>a <noscript>b <img></noscript> c</p>") == ["a b c"]
    svg = '<svg class="plot"><title>Chart</title><path d="M0"/><text>Up <tspan>10</tspan></text><path d="x"></svg>'
    got = [b[:2] for b in blocks(f'<main><p>one {svg}two</p><p>three</p></main>')]
    assert got == [(("main", "p"), "one two"), (("main", "p", "svg.plot", "title"), "Chart"), (("main", "p", "svg.plot", "text"), "Up 10"),
                   (("main", "p"), "three")]
    assert texts("<ul><li>a<template><li>x</template>b</ul>") == ["ab", "x"]
    assert texts("<p>a<svg/>b<textarea>no</textarea><iframe><p>no</iframe></p>") == ["ab"]
    assert [b[2] for b in blocks('<p><a href="/">a<svg><path/></svg>b</a> cd</p>')] == [2]


@pytest.mark.parametrize("tag", ["object", "svg", "noscript", "math", "template"])
def test_an_open_element_ends_with_its_ancestor(tag):
    got = [b[:2] for b in blocks(f"<body><div><p>a <{tag}> b</p><p>c</p></div><div><{tag}><b>d</b></div><p>e</p></body>")]
    assert [t for _, t in got][-3:] == ["c", "d", "e"] and " ".join(t for _, t in got) == "a b c d e"
    assert [p for p, t in got if t in "ce"] == [("body", "div", "p"), ("body", "p")]
    assert texts(f"a<{tag}>") == ["a"] and texts(f"a<{tag}>b") in (["ab"], ["a b"], ["a", "b"])
    assert len(blocks(f"<p>a<{tag}>b" * 3000)) >= 3000 or tag == "template"


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    pages = [X.encode(blocks("<article><p>one two</p><p>three.</p></article><footer>x</footer>")), X.encode(blocks("<nav>a</nav><p>b c"))]
    y = [np.array([1.0, 0, 1]), np.array([0.0, 1])]
    net = X.Labeller()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss():
        p = net.forward(pages)[0]
        t = np.concatenate(y)
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()

    start = loss()
    for _ in range(25):
        net.fit(pages, y, epochs=3, batch=2)
    assert loss() < 0.05 < start


def test_padding_does_not_change_a_page():
    net = X.Labeller()
    a, b = (X.encode(blocks(p)) for p in ("<p>x<p>y", "<p>q" * 40))
    both = net.forward([a, b])[0]
    np.testing.assert_allclose(both[:2], net.forward([a])[0], rtol=1e-4)
    np.testing.assert_allclose(both[2:], net.forward([b])[0], rtol=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    return X.train(C.table(spark, SF01, "pages"))


def truth(page):
    """Article text of the known page form."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    parts = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_known_page_form(spark, model):
    rows = X.extract(C.table(spark, "/root/testdata/sf0.1", "pages"), model).collect()
    bad = [r.row.page_id for r in rows if r.text != truth(r.row.html)]
    assert len(rows) == 2500 and len(bad) <= 2 and all(r.n_chars == len(r.text) for r in rows)


OTHER = """<html><head><title>T</title><script>x()</script></head><body><header class="top"><a href="/">Home</a></header>
<div class="cookie-notice"><p>We use cookies. Accept them all.</p></div><main><h1>Bees &amp; flowers</h1><p>Bees fly from flower to flower all day long.</p>
<div class="ad"><p>Buy honey now, cheap and sweet.</p></div><p>They   carry pollen<br>and make honey in the hive.</p><form><label>Mail</label><input></form></main>
<aside class="sidebar"><p>Most read stories of the week.</p></aside><section class="comments"><h2>Comments</h2><p>I like bees a lot, thanks.</p></section>
<footer>Copyright</footer></body></html>"""


def test_another_page_form_and_defined_cases(spark, model):
    rows = [(1, "u", OTHER, "t"), (2, "u", None, "t"), (3, "u", "", "t"), (4, "u", "<script>x</script>", "t"), (None, None, OTHER, None),
            (5, "u", "<article>" + "<p>word word word word word.</p>" * 30_000 + "</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {r.row.page_id: r for r in X.extract(df, model).collect()}
    want = "Bees & flowers\nBees fly from flower to flower all day long.\nThey carry pollen and make honey in the hive."
    assert got[1].text == want and got[None].text == want and got[1].row.text == "t"
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""]
    assert got[5].n_chars > 29_000 * 25
    assert {r.text for r in X.extract(df, None).collect()} == {""}
    assert X.train(df.limit(0)) is None and X.extract(df.limit(0), model).count() == 0


def test_a_deep_path_keeps_the_name_of_every_container():
    """A comment list between many plain containers, and list items far above the next one."""
    page = "<div>" * 10 + '<div class="comments">' + "<div>" * 20 + "<p>a comment that is deep down" + "</div>" * 31 + "<p>after"
    leaf = blocks(page)
    assert [b[1] for b in leaf] == ["a comment that is deep down", "after"]
    assert any("comments" in x.split(".") for x in leaf[0][0]) and not any("comments" in x for x in leaf[1][0])
    assert X.weak_label(leaf[0][0], False) == 0
    item = "<ul><li>one" + "<x-a>" * 40 + "deep<li>two</ul>"
    assert [b[0][-1] for b in blocks(item)] == ["li", "x-a", "li"] and len(blocks(item)[2][0]) == 2
    assert len(blocks("<div>" * 5000 + "<p>x" * 2000)) == 2000


def test_training_bounds_are_parameters(spark):
    page = "<html><body><nav><a href='/'>home</a></nav><article><p>" + "some plain words of text " * 40 + "</p></article></body></html>"
    pages = spark.createDataFrame([(1, page), (2, page)], "page_id long, html string")
    assert X.train(pages, sample_chars=100) is None
    assert X.train(pages, sample_chars=5000, snippet_chars=10) is not None
