"""Main text: the reader of pages, exact marginals, and held-out pages."""

import itertools
import random

import numpy as np
import pytest

from biotally.llm import dom, html_text, layouts

SF = "/root/testdata/sf0.001"


def texts(page):
    return [t for t in dom.read(page).text if t]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []), ("", []), ("plain & simple", ["plain & simple"]), ("a &lt;b&gt; &amp c &am d &#233;&nbsp;e", ["a <b> & c &am d é e"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]), ("<p><b>bold<br>still<p>next</b> end", ["bold still", "next end"]),
        ("<script>var t='</p>';if(a<b){}</script><style>p{}</style><p>x", ["x"]), ("<script>never ended <p>x", []), ("a<!-- <p>no</p> -->b<!-->c<!--open", ["abc"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<form>q<select><option>a<option>b</select><textarea>t<p></textarea><button>go</button></form>z", ["q", "z"]),
        ("x < y and a<b c='>'d>e</b>", ["x < y and ae"]), ("<p title='a>b' class=\"x\">t</p attr>u", ["t", "u"]), ("<head><title>T</title><p>body", ["body"]), ("</p></x><div></div>a</div>b", ["a", "b"]),
        ("<a href=1>one<a href=2>two</a>", ["onetwo"]), ("<dl><dt>t<dd>d<dt>t2</dl>", ["t", "d", "t2"]), ("a\n\n  b\t c", ["a b c"]), ("<p>cut <a href='", ["cut"]), ("&", ["&"]), ("<", ["<"]), ("</>a<?x?>b<!DOCTYPE html>c", ["abc"]),
        ("<svg><text>no</text></svg>yes<noscript>no</noscript>", ["yes"]), ("<p>a<span>b</span>c</p>", ["abc"]), ("<h1>a<h2>b", ["a", "b"]), ("İ<P>K</P>", ["İ", "K"]),
    ],
)
def test_reader(page, want):
    assert texts(page) == want


def test_trees_are_consistent():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class='a'>", "</div>", "<ul>", "<li>", "</ul>", "<td>", "<table>", "</table>", "<a href=1>", "</a>", "x y ", "<b>", "</b>", "<select>", "</select>", "<head>", "<br>", "<h1>", "<!--", "-->", "<button>", "&amp;"]
    for _ in range(400):
        page = dom.read("".join(rng.choice(bits) for _ in range(rng.randrange(60))))
        n = len(page.tag)
        assert page.parent[0] == -1 and page.end[0] == n
        for i in range(1, n):
            up = page.parent[i]
            assert 0 <= up < i and i < page.end[i] <= page.end[up] and page.depth[i] == page.depth[up] + 1
            assert (page.tag[i] == "#text") == bool(page.text[i])


def test_reading_is_linear():
    assert texts("<div>" * 50_000 + "x") == ["x"]
    assert texts("<p>" * 100_000 + "x") == ["x"]
    assert texts("<a " * 100_000) == []
    assert texts("<b><i>" * 30_000 + "x" + "</p></q>" * 30_000) == ["x"]
    assert texts("<!--" * 100_000) == []
    assert len(texts("<li>a" * 50_000)) == 50_000


def brute_marginals(t, m):
    """By summing over all states of a small tree."""
    n = len(t.parent)
    score = t.features.astype(float) @ m.unary
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(score[i] * y[i] for i in range(n)) + sum(m.pair[t.edge[i], y[t.parent[i]], y[i]] for i in range(n) if t.parent[i] >= 0)
        w = np.exp(s)
        total += w
        on += w * np.array(y)
    return on / total


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    page = "<nav><a href=1>m</a></nav><article><h1>t</h1><p>a b c.</p><ul><li>x<li>y</ul></article><p>z"
    pages = [dom.read(page), dom.read("<div>only</div>"), dom.read("")]
    m = html_text.Model(rng.normal(size=html_text._width()), rng.normal(size=(6, 2, 2)))
    for p in pages:
        t = html_text.forest([p])
        assert np.allclose(html_text.messages(t, m)[0], brute_marginals(t, m), atol=1e-5)
    both, _ = html_text.messages(html_text.forest(pages), m)
    each = np.concatenate([html_text.messages(html_text.forest([p]), m)[0] for p in pages])
    assert np.allclose(both, each, atol=1e-6)


def test_gradient_is_that_of_the_likelihood():
    """Expected features at the marginals: by differences of log Z."""
    rng = np.random.default_rng(3)
    t = html_text.forest([dom.read("<nav>m</nav><article><p>a b.</p><p>c</p></article>")])
    m = html_text.Model(rng.normal(size=html_text._width()) * 0.3, rng.normal(size=(6, 2, 2)))

    def log_z(m):
        n, total = len(t.parent), 0.0
        score = t.features.astype(float) @ m.unary
        for y in itertools.product((0, 1), repeat=n):
            total += np.exp(score @ y + sum(m.pair[t.edge[i], y[t.parent[i]], y[i]] for i in range(1, n)))
        return np.log(total)

    p, edges = html_text.messages(t, m)
    h = 1e-5
    for kind, a, b in itertools.product(range(6), (0, 1), (0, 1)):
        moved = html_text.Model(m.unary, m.pair.copy())
        moved.pair[kind, a, b] += h
        assert (log_z(moved) - log_z(m)) / h == pytest.approx(edges[(t.edge == kind) & (t.parent >= 0), a, b].sum(), abs=1e-3)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit(pages)


def test_held_out_layouts(pages, model):
    """Layouts drawn with other numbers, on texts of other pages."""
    pool = sorted({t for r in pages.collect() for t in dom.read(r["html"]).text if t})
    rng = random.Random(12345)
    right = wrong = missed = 0
    for _ in range(150):
        page, marks = layouts.laid_out(pool, rng)
        tree = dom.read(page)
        t = html_text.forest([tree])
        got = html_text.messages(t, model)[0][t.is_text] >= 0.5
        assert len(got) == len(marks)
        for g, y, size in zip(got, marks, [len(x) for x in tree.text if x], strict=True):
            right += size * (g and y)
            wrong += size * (g and not y)
            missed += size * (y and not g)
    assert right / (right + wrong) > 0.93
    assert right / (right + missed) > 0.93


P = "The quick brown fox jumps over the lazy dog, and then it runs away into the deep forest where nobody can find it."
Q = "Another paragraph with a good many words follows here; it speaks of things that matter to those who read it."
BY_HAND = [
    (f'<nav><a href=1>Home</a></nav><div class="ad">{Q}</div><article><h1>Head</h1><p><b>{P}<br><p>{Q}</p></article><footer>&copy; x {Q}</footer>', ["Head", P, Q]),
    (f'<div id="header"><a href="/">My Blog</a></div><div id="content"><div class="post"><h2>Title of it</h2><p>{P}</p><p>{Q}</p></div><div id="comments"><div class="comment"><b>Bob</b><p>{Q}</p></div></div></div><div id="sidebar"><h3>Recent</h3><ul><li><a href=1>Old post</a></ul><p>{P}</p></div><div id="footer"><p>Copyright</p></div>', ["Title of it", P, Q]),
    (f'<div class="cookie-banner"><p>{Q}</p><button>OK</button></div><main><h1>News title</h1><p>{P}</p><aside class="ad"><p>{P}</p></aside><p>{Q}</p><h2>More</h2><p>{P}</p></main><section class="comments"><p>{P}</p></section>', ["News title", P, Q, "More", P]),
]


@pytest.mark.parametrize(("page", "want"), BY_HAND)
def test_pages_by_hand(model, page, want):
    assert html_text.blocks([dom.read(page)], model) == [want]


def test_query(spark, pages, model):
    """Every row, with what its article holds; odd rows have defined results."""
    got = {r["page_id"]: r for r in html_text.main_text(pages, model=model).collect()}
    exact = 0
    for r in pages.collect():
        tree = dom.read(r["html"])
        want = "\n\n".join(t for t, inside in zip([x for x in tree.text if x], html_text._marked(tree), strict=True) if inside)
        row = got[r["page_id"]]
        assert (row["n_chars"], row["url"]) == (len(row["text"]), r["url"])
        exact += row["text"] == want
    assert len(got) == pages.count()
    assert exact >= 0.98 * len(got)
    odd = [(1, None, None), (1, "u", ""), (None, "u", "<p>"), (2, "u", BY_HAND[0][0]), (2, "u", BY_HAND[0][0]), (3, "u", "<div>" * 3000 + P + "<p>" + "w " * 200_000)]
    df = spark.createDataFrame([(*x, "clash", 5) for x in odd], "page_id long, url string, html string, text string, n_chars int")
    out = html_text.main_text(df, model=model).collect()
    assert [r["page_id"] for r in out] == [x[0] for x in odd]
    assert [r["n_chars"] for r in out][:3] == [0, 0, 0]
    assert out[3]["text"] == out[4]["text"] == "\n\n".join(BY_HAND[0][1])


def test_empty_tables(spark, pages):
    assert html_text.main_text(pages.limit(0)).collect() == []
    assert [r["text"] for r in html_text.main_text(spark.createDataFrame([(1, "u", None), (2, "u", "<p>")], "page_id long, url string, html string")).collect()] == ["", ""]


def test_the_sample_does_not_depend_on_partitions(pages):
    a = html_text.fit(pages.repartition(7), sample=20, layouts=10, steps=4)
    b = html_text.fit(pages.coalesce(1), sample=20, layouts=10, steps=4)
    assert np.array_equal(a.unary, b.unary) and np.array_equal(a.pair, b.pair)
