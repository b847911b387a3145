"""Main text of pages by a graphical model on their trees.

Every node of a page (its block elements, and the blocks of text that are its
leaves) is content or not. A node's potential is linear in its features: its
tag, the kind of its class and id names, the length of its text, how much of it
is linked, and where it stands. An edge's potential is a table of two states by
two for the kind of child. Sum-product messages run from the leaves up and from
the root down; on a tree that gives the exact marginals. Blocks whose marginal
is one half or more are the text. All pages of a batch go through together,
level by level, on arrays.

The model is trained here, by the gradient of the likelihood: features as they
are less as the marginals expect them. Its labelled pages come from a bounded
sample (``SAMPLE`` pages, those of the least hashes of their html): the sample's own blocks are laid out anew in
``LAYOUTS`` drawn layouts, in which it is known what is content; class names,
nesting, tags and order vary. Pages of the sample that mark one ``article``
count as labelled too.

Defined cases: null and empty pages, and pages without content, have an empty
text; repeated pages and ids are rows of their own; very long or deep pages are
read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .layouts import laid_out

SAMPLE, LAYOUTS, STEPS = 300, 600, 150
#: Bytes of a page that may be in the sample.
LONGEST = 1 << 20
#: Nodes that go through the model together.
NODES = 40_000

# What names of classes and ids tell.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar sitemap dropdown topbar skip",
    "head": "header masthead head branding logo tagline hero banner title site",
    "foot": "footer foot colophon copyright legal bottom credits contentinfo imprint",
    "side": "sidebar side aside widget rail related recommended trending popular complementary more teaser archive categories tagcloud promo box",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors partner partners adsense dfp promoted promotion commercial",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup paywall privacy bar message disclaimer",
    "comment": "comment comments commentlist disqus reply replies respond discussion responses feedback reviews review thread guestbook",
    "share": "share sharing social follow like tweet facebook buttons tools print",
    "form": "form search login register contact poll input field fields checkout survey",
    "meta": "meta byline author date time tags tag published info dateline bio",
    "content": "article content post entry story body main text prose copy post-body page articlebody maincontent",
}
KIND = {word: kind for kind, words in NAMES.items() for word in words.split()}
TAGS = "#root #text article main section div p h1 h2 h3 ul ol li dl table tr td blockquote pre figure figcaption header footer nav aside form fieldset details address center other".split()
_TAG = {t: i for i, t in enumerate(TAGS)} | {t: TAGS.index("h3") for t in ("h4", "h5", "h6")} | {"th": TAGS.index("td"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "thead": TAGS.index("tr"), "tbody": TAGS.index("tr"), "tfoot": TAGS.index("tr"), "menu": TAGS.index("ul")}
_GROUPS = list(NAMES)
#: Upper ends of the classes of a length in words, and of shares.
WORDS, SHARES = (2, 5, 12, 25, 60), (0.02, 0.25, 0.6)
#: Edges: the child is a block of text, names something, is a plain wrapper, or one of the tags that say what they hold.
_EDGES = 6


def _width() -> int:
    return 2 * len(TAGS) + 2 * len(_GROUPS) + 2 * (len(WORDS) + 1) + 3 * (len(SHARES) + 1) + 9


@dataclass
class Trees:
    """Pages of a batch as one forest; ``page`` and ``node`` tell whose a row is."""

    page: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    edge: np.ndarray
    features: np.ndarray
    is_text: np.ndarray
    texts: list[str]


def _classes(values: np.ndarray, edges: tuple) -> np.ndarray:
    return np.searchsorted(np.asarray(edges, dtype=float), values, "left")


def forest(pages: list[dom.Page]) -> Trees:
    """Features of all nodes of all pages."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    page = np.repeat(np.arange(len(pages)), sizes)
    n = int(sizes.sum())
    flat = lambda name: [v for p in pages for v in getattr(p, name)]
    names, tags, texts = flat("names"), flat("tag"), flat("text")
    tag = np.array([_TAG.get(t, len(TAGS) - 1) for t in tags])
    parent = np.array(flat("parent")) + base
    depth = np.array(flat("depth"))
    parent[depth == 0] = -1
    end = np.array(flat("end")) + base
    is_text = tag == _TAG["#text"]
    here = np.arange(n)
    groups = np.zeros((n, len(_GROUPS)), dtype=bool)
    for i in np.flatnonzero([bool(x) for x in names]).tolist():
        for word in _words(names[i]):
            if word in KIND:
                groups[i, _GROUPS.index(KIND[word])] = True

    own = np.zeros((n, 5))  # text blocks, characters, linked characters, words, sentence marks
    spots = np.flatnonzero(is_text)
    own[spots, 0] = 1
    own[spots, 1] = [len(texts[i]) for i in spots.tolist()]
    own[spots, 2] = np.array(flat("linked"))[spots]
    own[spots, 3] = [texts[i].count(" ") + 1 for i in spots.tolist()]
    own[spots, 4] = [sum(map(texts[i].count, ".!?,;。，")) for i in spots.tolist()]
    sums = np.concatenate([np.zeros((1, 5)), np.cumsum(own, axis=0)])
    under = sums[end] - sums[here]
    before = sums[here] - sums[base]
    whole = under[base]
    blocks = np.maximum(under[:, 0], 1)
    up = np.where(parent >= 0, parent, here)

    out = np.zeros((n, _width()), dtype=np.float32)
    at = 0

    def one_hot(values: np.ndarray, width: int) -> None:
        nonlocal at
        out[here, at + values] = 1
        at += width

    one_hot(tag, len(TAGS))
    one_hot(np.where(parent >= 0, tag[up], 0), len(TAGS))
    out[:, at : at + len(_GROUPS)] = groups
    at += len(_GROUPS)
    out[:, at : at + len(_GROUPS)] = groups[up] & (parent >= 0)[:, None]
    at += len(_GROUPS)
    one_hot(_classes(under[:, 3] / blocks, WORDS), len(WORDS) + 1)
    one_hot(_classes(under[up, 3] / np.maximum(under[up, 0], 1), WORDS), len(WORDS) + 1)
    one_hot(_classes(under[:, 2] / np.maximum(under[:, 1], 1), SHARES), len(SHARES) + 1)
    one_hot(_classes(under[up, 2] / np.maximum(under[up, 1], 1), SHARES), len(SHARES) + 1)
    one_hot(_classes(under[:, 1] / np.maximum(whole[:, 1], 1), SHARES), len(SHARES) + 1)
    hidden = np.array(flat("hidden"))
    out[:, at] = 1
    out[:, at + 1] = hidden
    out[:, at + 2] = np.minimum(under[:, 4] / np.maximum(under[:, 3], 1) * 4, 1)
    out[:, at + 3] = np.minimum(under[up, 4] / np.maximum(under[up, 3], 1) * 4, 1)
    out[:, at + 4] = before[:, 1] / np.maximum(whole[:, 1], 1)
    out[:, at + 5] = under[:, 0] == 0
    out[:, at + 6] = np.log1p(under[:, 1]) / 10
    out[:, at + 7] = np.minimum(depth, 12) / 12
    out[:, at + 8] = [x[:1] == "©" or "©" in x[:40] for x in texts]

    says = np.isin(tag, [_TAG[t] for t in "article main header footer nav aside form".split()])
    plain = np.isin(tag, [_TAG[t] for t in "div section center tr td table".split()])
    items = np.isin(tag, [_TAG[t] for t in "ul ol li dl".split()])
    edge = np.select([is_text, says, groups.any(axis=1), plain, items], [0, 1, 2, 3, 4], 5)
    return Trees(page, parent, depth, edge, out, is_text, texts)


def _words(names: str) -> Iterator[str]:
    """Words of class and id names: at marks, at capitals, and whole."""
    for name in names.split():
        low = name.lower()
        yield low
        start = 0
        for i in range(1, len(name) + 1):
            if i == len(name) or not name[i].isalpha() or (name[i].isupper() and name[i - 1].islower()):
                if i > start:
                    yield low[start:i].strip("-_0123456789")
                start = i if i < len(name) and name[i].isalpha() else i + 1


@dataclass
class Model:
    unary: np.ndarray  # a node's weight for content
    pair: np.ndarray  # (edge kind, state of the parent, state of the child)


def _levels(t: Trees) -> list[np.ndarray]:
    order = np.argsort(t.depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(t.depth))[:-1]) if len(order) else []


def _sum_over(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exponentials over one of the two-state axes."""
    a, b = np.take(x, 0, axis), np.take(x, 1, axis)
    return np.logaddexp(a, b)


def _add(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to those of ``out`` at places that come in order and repeat."""
    first = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[first]] += np.add.reduceat(rows, first, axis=0)


def messages(t: Trees, m: Model, levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes (content), and of the edges (parent, child states).

    Upward, a node tells its parent how well each of its states goes with what
    lies below; downward, how well with all the rest of the page."""
    levels = _levels(t) if levels is None else levels
    n = len(t.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = t.features @ m.unary.astype(np.float32)
    pair = m.pair[t.edge]
    up = np.zeros((n, 2))
    for level in reversed(levels[1:]):
        up[level] = _sum_over(pair[level] + belief[level][:, None, :], 2)
        _add(belief, t.parent[level], up[level])
    down = np.zeros((n, 2))
    edges = np.zeros((n, 2, 2))
    for level in levels[1:]:
        above = t.parent[level]
        rest = belief[above] + down[above] - up[level]
        joint = rest[:, :, None] + pair[level] + belief[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        p = np.exp(joint)
        edges[level] = p / p.sum(axis=(1, 2), keepdims=True)
        down[level] = _sum_over(rest[:, :, None] + pair[level], 1)
    total = belief + down
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), edges


def _labels_up(t: Trees, labels: np.ndarray) -> np.ndarray:
    """An element is content if half of its text is."""
    chars = np.where(t.is_text, [len(x) for x in t.texts], 0).astype(float)
    both = np.stack([chars, chars * labels], axis=1)
    for level in reversed(_levels(t)[1:]):
        _add(both, t.parent[level], both[level])
    return np.where(t.is_text, labels, (both[:, 1] > 0) & (2 * both[:, 1] >= both[:, 0])).astype(float)


def train(pages: list[dom.Page], labels: list[list[bool]], steps: int = STEPS) -> Model:
    """Maximum likelihood with a small penalty, by Adam on the exact gradient;
    every page weighs the same. ``labels``: of each page's blocks of text."""
    t = forest(pages)
    y = np.zeros(len(t.parent))
    y[t.is_text] = [v for page in labels for v in page]
    y = _labels_up(t, y)
    levels = _levels(t)
    weight = 1 / np.bincount(t.page)[t.page] / len(pages)
    inner = np.flatnonzero(t.parent >= 0)
    # Sums over the edges of each kind, as one product.
    kinds = (np.eye(_EDGES)[t.edge[inner]] * weight[inner, None]).T
    seen = np.zeros((len(inner), 4))
    seen[np.arange(len(inner)), (2 * y[t.parent[inner]] + y[inner]).astype(int)] = 1
    seen = kinds @ seen
    m = Model(np.zeros(t.features.shape[1]), np.zeros((_EDGES, 2, 2)))
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.unary, m.pair)]
    for step in range(1, steps + 1):
        p, edges = messages(t, m, levels)
        pair = (seen - kinds @ edges[inner].reshape(-1, 4)).reshape(m.pair.shape)
        gradients = (((y - p) * weight).astype(np.float32) @ t.features - 2e-5 * m.unary, pair - 2e-5 * m.pair)
        for w, g, mv in zip((m.unary, m.pair), gradients, moments, strict=True):
            mv[0] = 0.9 * mv[0] + 0.1 * g
            mv[1] = 0.99 * mv[1] + 0.01 * g * g
            w += 0.15 * (1 - step / (steps + 1)) * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.99**step)) + 1e-9)
    return m


def blocks(pages: list[dom.Page], m: Model) -> list[list[str]]:
    """The content blocks of each page, in order."""
    t = forest(pages)
    p, _ = messages(t, m)
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(t.is_text & (p >= 0.5)).tolist():
        out[t.page[i]].append(t.texts[i])
    return out


def _marked(page: dom.Page) -> list[bool] | None:
    """Labels of a page that marks one article: what is inside, but for parts
    that name themselves something else."""
    articles = [i for i, t in enumerate(page.tag) if t == "article"]
    if len(articles) != 1:
        return None
    inside = np.zeros(len(page.tag), dtype=bool)
    inside[articles[0] : page.end[articles[0]]] = True
    for i in range(articles[0] + 1, page.end[articles[0]]):
        kinds = {KIND.get(w) for w in _words(page.names[i])} - {None, "content", "meta", "head"}
        if page.tag[i] in ("nav", "aside", "footer", "form") or kinds:
            inside[i : page.end[i]] = False
    return [bool(inside[i]) for i, t in enumerate(page.tag) if t == "#text"]


def fit(pages: DataFrame, html_col: str = "html", *, sample: int = SAMPLE, layouts: int = LAYOUTS, steps: int = STEPS, seed: int = 7) -> Model | None:
    """The model for ``pages``, from at most ``sample`` of them; None if they
    hold no text."""
    key = F.xxhash64("html")
    rows = pages.select(F.col(html_col).alias("html")).where(F.octet_length("html") <= LONGEST)
    # The least hashes: the same pages however the table is cut, copies once.
    least = [r[0] for r in rows.select(key.alias("key")).distinct().orderBy("key").limit(sample).collect()]
    found = rows.where(key.isin(least)).dropDuplicates(["html"]).orderBy("html").collect() if least else []
    taken = [dom.read(r[0]) for r in found]
    pool = sorted({t for p in taken for t in p.text if t})
    if not pool:
        return None
    trees, labels = [], []
    for p in taken:
        if (marks := _marked(p)) is not None:
            trees.append(p)
            labels.append(marks)
    rng = random.Random(seed)
    for _ in range(layouts):
        page, marks = laid_out(pool, rng)
        trees.append(dom.read(page))
        labels.append(marks)
    return train(trees, labels, steps)


def main_text(pages: DataFrame, html_col: str = "html", *, model: Model | None = None, **options) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    model = model or fit(pages, html_col, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            waiting: list[dom.Page] = []
            size = 0
            for page in batch.column("html").to_pylist():
                waiting.append(dom.read(page))
                size += len(waiting[-1].tag)
                if size > NODES:
                    texts += ["\n\n".join(x) for x in blocks(waiting, model)]
                    waiting, size = [], 0
            texts += ["\n\n".join(x) for x in blocks(waiting, model)] if waiting else []
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    if model is None:
        return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
