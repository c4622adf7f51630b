"""Main text of pages: messages against enumeration, held-out accuracy, and pages written by hand."""

import html
import itertools
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from ziplore.llm import page_text as P
from ziplore.llm.queries import op12_html_extraction

SF = "/root/testdata/sf0.01"


def forest_of(*pages):
    forest = P.Forest()
    for page in pages:
        P.read_page(page, forest)
    return forest


def blocks(page):
    """Tags of the elements around each block, and its text."""
    forest = forest_of(page)
    return [t for t in forest.texts if t is not None]


def test_marginals_equal_enumeration():
    """All assignments of small trees, two pages at once."""
    pages = ["<div>a<p>b c</p></div><ul><li>d", "<article><h1>x</h1><p>y</article>z"]
    forest = forest_of(*pages)
    tree = P.Tree(forest)
    rng = np.random.default_rng(3)
    n = len(forest.parent)
    assert 10 < n < 17
    for _ in range(3):
        scores, edges = rng.normal(0, 2, n), rng.normal(0, 2, (len(P.EDGES), 2, 2))
        weights, held, joint = [], [], []
        for x in itertools.product((0, 1), repeat=n):
            total = sum(s for s, v in zip(scores, x) if v)
            total += sum(edges[forest.edge[i], x[p], x[i]] for i, p in enumerate(forest.parent) if p >= 0)
            weights.append(np.exp(total))
            held.append(x)
        held, weights = np.array(held, float), np.array(weights) / sum(weights)
        marginal, inner, outer = tree.beliefs(scores, edges)
        assert np.allclose(marginal, weights @ held)
        children = [i for i, p in enumerate(forest.parent) if p >= 0]
        for i, pair in zip(children, tree.pairs(edges, inner, outer)):
            joint = [[(weights * (held[:, forest.parent[i]] == a) * (held[:, i] == b)).sum() for b in (0, 1)] for a in (0, 1)]
            assert np.allclose(pair, joint)


@pytest.fixture(scope="module")
def model():
    return P.default_model()


def test_held_out_accuracy(model):
    """Blocks of generated pages that were not learned from."""
    pages = P.generated_pages(400, 77)
    got = P.main_texts([source for source, _ in pages], model)
    right = extra = lost = 0
    for text, (_, main) in zip(got, pages):
        a, b = (Counter(t.split("\n") if t else []) for t in (text, main))
        right, extra, lost = right + (a & b).total(), extra + (a - b).total(), lost + (b - a).total()
    assert right / (right + extra) > 0.97 and right / (right + lost) > 0.97
    assert sum(t == main for t, (_, main) in zip(got, pages)) / len(pages) > 0.8


def test_fit_raises_the_likelihood():
    """Each label's marginal grows against no weights at all."""
    pages = P.generated_pages(60, 5)
    fitted = P.train(pages)
    forest = forest_of(*(source for source, _ in pages))
    tree = P.Tree(forest)
    truth = P.labels_of(forest, tree, [main for _, main in pages])
    marginal = tree.beliefs(tree.node_scores(fitted.nodes), fitted.edges)[0]
    assert np.where(truth, marginal, 1 - marginal).mean() > 0.95
    # At the optimum expectations meet the labels, up to the pull of the ridge.
    assert abs(truth.mean() - marginal.mean()) < 0.01


NAV = '<nav><ul><li><a href="/a">Home page</a></li><li><a href="/b">World news</a></li><li><a href="/c">Sport</a></li></ul></nav>'
PROSE = [
    "The river rose by two metres overnight, and the lower town was without power until noon.",
    "Residents were moved to the school hall. Nobody was hurt, the mayor said, but the old bridge is closed.",
    "Engineers expect the water to fall from Thursday on.",
]
MAIN = "\n".join(["Flood in the lower town", *PROSE])
P_ALL = "".join(f"<p>{t}</p>" for t in PROSE)
BY_HAND = {
    "article": f"<html><head><title>Flood | News</title></head><body>{NAV}<article><h1>Flood in the lower town</h1>{P_ALL}</article>"
    "<footer>&copy; 2021 News. All rights reserved.</footer></body></html>",
    "every kind": f"<header><div class=logo>The Daily News</div><p>News since 1901</p></header>{NAV}"
    '<div class="cookie-notice"><p>We use cookies to make this site better for you. By going on you accept them.</p><button>Accept</button></div>'
    f'<main><article><h1>Flood in the lower town</h1>{P_ALL}</article>'
    '<section class="comments"><h2>Comments</h2><div class="comment"><b>Anna</b><p>My cellar was full of water, and nobody came to help us for hours.</p></div></section></main>'
    '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Bridge to be rebuilt</a></li><li><a href="/2">Rain goes on</a></li></ul></aside>'
    '<div class="ad">Buy two umbrellas and get one for free at the shop on Main Street today.</div>'
    '<form class="newsletter"><p>Get our newsletter every morning.</p><label>Mail</label><input><button>Subscribe</button></form>'
    "<script>var p = '<p>Not text at all, is it?</p>';</script><style>p { color: red }</style><footer><p>Imprint | Contact | &copy; News</p></footer>",
    "divs": f'<div id="header"><div>The Daily News</div></div><div class="menu"><a href=/>Home</a> | <a href=/n>News</a></div>'
    f'<div id="content" class="post"><h1>Flood in the lower town</h1>{P_ALL}</div><div id="sidebar"><p>Weather: rain, 12 degrees.</p></div>'
    '<div id="comments"><ol><li><p>First! What a terrible night that was for all of us here.</p></li></ol></div><div id="footer">Copyright News</div>',
    "inside": f'<article><h1>Flood in the lower town</h1><p>{PROSE[0]}</p><div class="advert">Dry socks, now only five coins a pair, while stocks last.</div>'
    f'<p>{PROSE[1]}</p><aside class="related"><a href="/x">See also: floods of the past</a></aside><p>{PROSE[2]}</p></article>',
    "no end tags": f"{NAV}<article><h1>Flood in the lower town</h1><p><b>{PROSE[0]}<br><p>{PROSE[1]}<p>{PROSE[2]}</article><footer>&copy; News",
    "markup": f"<article><h1>Flood in the <em>lower</em>\n town</h1><p>{PROSE[0].replace('metres', '<a href=/m title=a&gt;b>metres</a>')}</p>"
    f"<!-- <p>gone</p> --><p>{PROSE[1].replace('Nobody', 'No&#98;ody').replace('old', '&#x6f;ld')}</p><p data-x='>'>\t{PROSE[2]}&nbsp;</p></article>",
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_by_hand(model, name):
    assert P.main_texts([BY_HAND[name]], model) == [MAIN]


@pytest.mark.parametrize(
    "page, found",
    [
        ("a &lt;b&gt; &amp;amp; 1 < 2 &eacute;&#233;&zzz;", ["a <b> &amp; 1 < 2 éé&zzz;"]),
        ("<p>a<p>b<div>c</p>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("x<script>y</script >z<SCRIPT>y", ["x", "z"]),
        ("<title>t</title>a<title>b", ["a", "b"]),
        ("a<!-- b --!>c<!-->d<!DOCTYPE e>f</ g>h<?i?>j<!-- k", ["acdfhj"]),
        ("a<br>b<hr>c<span>d</span>e", ["a b", "cde"]),
        ("<div title='<p>x</p>' class=a>b</div", ["b"]),
        ("</p></div>a</article>", ["a"]),
        ("<p>a" + "<div>" * 3000 + "b", ["a", "b"]),
        ("\x00\ud800 a", ["\x00\ud800 a"]),
    ],
)
def test_reading(page, found):
    assert blocks(page) == found


def test_reading_takes_linear_time():
    began = time.monotonic()
    for part in ("<a x='\"", "<a x=", "<!-", "<p", "<div>", "</div>", "<", "<b><p>", "<li><p>", "<title>", "<td>", "&amp", "<p><a href=x>"):
        P.main_texts([part * 100_000], P.Model(np.zeros(len(P.FEATURES)), np.zeros((len(P.EDGES), 2, 2))))
    assert time.monotonic() - began < 200


def expected(page):
    """Main text of the test tables, whose pages all have an article without anything else in it."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"</?(?:b|br|p|h1)>", "", part)).split()) for part in re.split(r"</?p>|</?h1>", inner)]
    return "\n".join(part for part in parts if part)


def test_query_on_the_table(spark):
    rows = {r["page_id"]: r for r in op12_html_extraction(spark, SF).collect()}
    pages = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for page_id, url, source in pages:
        assert rows[page_id]["text"] == expected(source)
        assert (rows[page_id]["url"], rows[page_id]["n_chars"]) == (url, len(rows[page_id]["text"]))


def test_awkward_rows_and_columns(spark, tmp_path):
    long = "<article><h1>Long</h1>" + "".join(f"<p>Sentence number {i} goes on and on here.</p>" for i in range(30_000)) + "</article>"
    pages = [(1, None, None), (2, "u", ""), (3, "u", " \n "), (None, None, BY_HAND["article"]), (4, "u", BY_HAND["article"]), (4, "u", BY_HAND["article"]), (5, "u", long)]
    rows = [(h, i, u, "x", 1) for i, u, h in pages]
    spark.createDataFrame(rows, "html string, page_id long, url string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    out = op12_html_extraction(spark, str(tmp_path))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(r[2] for r in got if r[0] in (1, 2, 3)) == ["", "", ""]
    assert [r[2] for r in got if r[0] in (None, 4)] == [MAIN] * 3
    assert [r[2].count("\n") for r in got if r[0] == 5] == [30_000]
    assert P.extract_text(spark.read.parquet(f"{tmp_path}/pages.parquet").limit(0)).count() == 0
