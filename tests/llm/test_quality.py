"""The classifier against plain loops: statistics, splits, leaves and scores."""

import collections
import math
import string
import zlib

import numpy as np
import pytest

from biotally.llm import queries, quality

SF = "/root/testdata/sf0.001"
ROWS = 12_000


def statistics_by_hand(text):
    """The statistics, read off the text character by character."""
    if not text:
        return [0.0] * 24
    raw = list(text.encode("utf-8", "surrogatepass"))
    n = len(raw)
    share = lambda chars: sum(c in chars for c in raw) / n
    codes = lambda s: {ord(c) for c in s}
    words = bytes(raw).split()
    m = max(1, len(words))
    count = collections.Counter(words)
    lines = [x for x in bytes(raw).split(b"\n") if x.strip()]
    k = max(1, len(lines))
    entropy = -sum(c / n * math.log2(c / n) for c in collections.Counter(raw).values())
    symbols = codes("#$%&*+/<=>@[\\]^_`{|}~")
    marks = sum(chr(w[-1]) in string.punctuation[:15] + ":;<=>?@" for w in words)
    return [
        math.log1p(len(text)), math.log1p(len(words)), sum(map(len, words)) / m, sum(len(w) > 14 for w in words) / m,
        share(codes(string.ascii_letters)), share(codes(string.ascii_uppercase)), share(codes(string.digits)), share({32, 9, 11, 12, 13}), share({10}), share(codes(".?!")), share(codes(",;:'\"()-")), share(symbols), share(set(range(128, 256))),
        entropy, len(count) / m, max(count.values(), default=0) / m, 1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1), len(set(lines)) / k, math.log1p(n / k),
        sum(chr(x.rstrip()[-1]) not in ".?!\"')" for x in lines) / k, marks / m, m / max(1, sum(c in codes(".?!") for c in raw)), sum(w.isupper() for w in words) / m, sum(len(w) == 1 for w in words) / m,
    ]


def descend(forest, x):
    z = forest.prior
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        z += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-z))


def check_forest(forest, x, y):
    """Every split is as good as any that a full search finds, and every leaf is
    its Newton step."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(x.shape[1])]
    z = np.full(len(y), forest.prior)
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.RIDGE)  # noqa: B023, E731
        own = {0: np.arange(len(y))}
        for node in range(len(feature)):
            rows = own[node]

            def gain(f, t, rows=rows):
                left = x[rows, f] <= t
                if min(left.sum(), (~left).sum()) < quality.LEAST:
                    return -1.0
                return part(rows[left]) + part(rows[~left]) - part(rows)

            best = max((gain(f, t) for f in range(x.shape[1]) for t in edges[f]), default=-1.0) if len(rows) >= 2 * quality.LEAST else -1.0
            if np.isfinite(threshold[node]):
                assert gain(feature[node], threshold[node]) >= best - 1e-9
            else:
                assert best <= 1e-6 + 1e-9
            left = x[rows, feature[node]] <= threshold[node]
            own[2 * node + 1], own[2 * node + 2] = rows[left], rows[~left]
        for k, value in enumerate(leaf):
            rows = own[k + len(feature)]
            assert value == pytest.approx(quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE), abs=1e-9)
            z[rows] += value


def forest_by_hand(spark, docs, labels_path):
    """Scores of the pandas rows (doc_id, text), by a forest that is checked first."""
    frame = spark.createDataFrame([(int(i), t) for i, t in zip(docs.doc_id, docs.text, strict=True)], "doc_id long, text string")
    labels = spark.read.parquet(labels_path)
    forest = quality.train(frame, labels)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = [(statistics_by_hand(t or ""), known[i]) for i, t in sorted(zip(docs.doc_id, docs.text, strict=True)) if i in known]
    assert 0 < len(rows) <= ROWS
    check_forest(forest, np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=float))
    return [descend(forest, statistics_by_hand(t or "")) for t in docs.text]


def test_op8_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = dict(zip(docs.doc_id, forest_by_hand(spark, docs, f"{SF}/labels.parquet"), strict=True))
    got = queries.op8_quality(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "A", "é" * 3000, "word " * 20_001, "x\ny\nx\n", "NaN 1.2 ß!", "a\x0bb\x1cc"])
def test_statistics(text):
    assert quality.statistics(text) == pytest.approx(statistics_by_hand(text), abs=1e-12)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.classify(docs.limit(0), labels).count() == quality.keep_good(docs.limit(0), labels).count() == 0
