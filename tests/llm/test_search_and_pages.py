import math
import random

import pytest
from pyspark.sql import functions as F

from planmill.llm import topk
from planmill.llm.components import components
from planmill.llm.fm_index import FmIndex
from planmill.llm.html_text import extract, parse, render

import numpy as np


def test_top_k(spark):
    own = random.Random(4)
    rows = [(i, [own.choice([0.0, 0.25, -0.5, 0.03]) for _ in range(own.choice([3, 4]))]) for i in range(60)]
    rows += [(60, None), (80, [1.0, None]), (100, [float("nan")]), (120, [float("inf")]), (None, [1.0]), (140, []), (7, rows[7][1]), (160, [0.5] * 4)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in good:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
            want |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:20], 1)}
    for blocks in ({}, {"candidates": 7, "queries": 2}):
        got = topk.top_k(table, F.col("vec_id") % 20 == 0, 20, **blocks).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_components(spark):
    own = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, own.randrange(6, 60)) for _ in range(20)] + [(own.randrange(200, 300), own.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    loops = {a for a, b in edges if a == b}
    assert {k: v for k, v in got.items()} == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= loops
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("alphabet,size", [(3, 200), (40, 500), (1, 30)])
def test_fm_index(alphabet, size):
    own = np.random.default_rng(alphabet)
    text = own.integers(1, alphabet + 1, size)
    index = FmIndex(text)
    for n in (1, 2, 5):
        patterns = np.array([text[i : i + n] for i in own.integers(0, size - n, 20)] + [own.integers(1, alphabet + 3, n) for _ in range(5)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(size - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


PAGES = [
    ("<p>a<p>b  c<br>d", "a\n\nb c\nd"),
    ("<html><head><title>t</title><style>p{}</style></head><body><div>x</div><div>y</div>", "x\ny"),
    ("<ul><li>a<li>b<ol><li>x</li><li>y</ol></ul>z", "- a\n- b\n  1. x\n  2. y\n\nz"),
    ("<table><tr><th>Name<th>Qty<tr><td>fig<td>12<tr><td>banana</table>", "Name    Qty\nfig     12\nbanana"),
    ("<table><tr><td colspan=2>wide cell</td><td>c</td></tr><tr><td>a</td><td>b</td><td>d</td></tr></table>", "wide cell  c\na  b       d"),
    ("a<!-- b -->c<script>var t='</p>';</script><div hidden>d</div><p style='display: none'>e</p>f", "acf"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("1 &lt; 2 &amp; &#233; &nosuch;", "1 < 2 & é &nosuch;"),
    ("</p></div><b>bold<p>x", "bold\n\nx"),
    ("", ""), ("<", "<"), ("<div <p>x", "x"), ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("x<head>y", "x y".replace(" ", "")),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_render(page, text):
    assert render(parse(page)) == text


VISIBLE = [
    ("a <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2</annotation></semantics></math> b", "a x=2 b"),
    ("a<svg><title>t</title><rect/><defs/><g>no<text x=1>one <tspan>two</tspan></text><text>three</text></g></svg>b", "a one two three b"),
    ("<svg><foreignObject><p>in</p></foreignObject></svg>z", "in\n\nz"),
    ("<svg><path/><p>out", "out"), ("<svg><style/><text>t</text></svg>", "t"),
    ("<svg><text><![CDATA[1 < 2]]></text></svg>", "1 < 2"),
    ("a<span style='visibility:hidden'>b<i style='visibility: visible'>c</i>d</span>e", "ace"),
    ("a<span style='display:none'>b<i style='visibility:visible'>c</i></span>d", "ad"),
    ("<span style='backface-visibility:hidden'>seen</span>", "seen"),
    ("<ul><li style='visibility:hidden'>x</li><li>y</ul>", "- y"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>k<td rowspan=0>a<tr><td>c<td>x<tbody><tr><td>d<td>e</table>", "k  a\nc     x\nd  e"),
    ("<table><tr><td style='visibility:hidden'>hid<td>b<tr><td>c<td>d</table>", "   b\nc  d"),
]


@pytest.mark.parametrize("page,text", VISIBLE)
def test_render_all_that_is_visible(page, text):
    assert render(parse(page)) == text


def test_render_deep_and_broken():
    assert render(parse("<div>" * 50_000 + "x")) == "x"
    own = random.Random(1)
    bits = ["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<pre>", "</pre>", "<b>", "</b>", "w ", "<br>", "<!--", "-->", "<script>", "</script>", "<a href='", "&amp;", "<dd>", "<blockquote>", "</blockquote>"]
    for _ in range(500):
        render(parse("".join(own.choice(bits) for _ in range(60))))


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "t"), (1, "u", "<p>a", "t"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (1, "a"), (1, "a")]
    assert extract(pages.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Components and sums beyond 64 bits are exact; only a score that has no place in the result is an error."""
    own = random.Random(3)
    choices = [0.25, -0.5, 1e9, -1e9, 1e17, -1e17, 3e18, 1e30, -1e30]
    rows = [(20 * k, [own.choice([0.0, 0.25, -3.0]), 0.0, own.choice([0.5, -1.0])]) for k in range(6)]
    rows += [(i, [own.choice(choices[:4]), own.choice(choices), own.choice(choices[:4])]) for i in range(1, 60) if i % 20]
    rows += [(61, [1e30, 0.0, 0.0]), (62, [-1e30, 0.0, 0.0]), (63, [2.0**60, 0.0, 0.0]), (64, [2.0**60 + 2.0**9, 0.0, 0.0])]
    exact = {i: [64 * int(x) if abs(x) > 2**53 else math.floor(64 * x) for x in v] for i, v in rows}

    def plain(q, k):
        scored = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)
        return [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]

    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    calm = table.filter("vec_id not in (61, 62, 63, 64)")
    want = {t for q in exact if q % 20 == 0 for t in [x for x in plain(q, 70) if x[2] not in (61, 62, 63, 64)]}
    want = {(q, r, i, s) for q in {w[0] for w in want} for r, (i, s) in enumerate([(w[2], w[3]) for w in sorted(want) if w[0] == q][:20], 1)}
    for blocks in ({}, {"candidates": 5, "queries": 2}):
        got = topk.top_k(calm, F.col("vec_id") % 20 == 0, 20, **blocks).collect()
        assert {tuple(r) for r in got} == want and all(abs(s) < 2**63 for *_, s in want)
    with pytest.raises(Exception, match="has no 64-bit integer"):
        topk.top_k(table.filter("vec_id in (0, 61)").withColumn("embedding", F.expr("if(vec_id = 0, array(1D), embedding)")), F.col("vec_id") == 0).collect()


PLAIN_TAG = (
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
)


def test_tokens_of_broken_markup():
    """The scanner finds what one regular expression finds, and takes no longer for markup that never ends."""
    import re
    import time

    from planmill.llm.html_text import Tokens

    plain = re.compile(PLAIN_TAG, re.S)
    own = random.Random(5)
    parts = ["<", "<a", " ", ">", '"', "'", "/", "</a>", "=", "<!--", "-->", "<!", "<?", "<![CDATA[", "]]>", "x", "\n", "é", '<b c="']
    for _ in range(8000):
        page = "".join(own.choice(parts) for _ in range(own.randrange(14)))
        want = [(m.start(), m.end(), m[0] if m[2] is None else None, m[2], m[3] or "") for m in plain.finditer(page)]
        got, at, tokens = [], 0, Tokens(page)
        while (t := tokens.next(at)) is not None:
            start, at, declaration, _, name, source = t
            got.append((start, at, declaration, name, source))
        assert got == want, page
    for part in ("<a ", '<a "', "<a '", "<a", '<a"', "<!--", '<a<b "', "</a x='"):
        for tail in ("", ">", ' ">', "'>"):
            page = part * (1_000_000 // len(part)) + tail
            begin = time.process_time()
            parse(page)
            assert time.process_time() - begin < 5, (part, tail)
