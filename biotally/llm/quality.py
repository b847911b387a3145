"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics are read from the whole text, one pass of byte counts and one of
words. Trees are fitted on the driver from a bounded sample of labelled rows
(``SAMPLE``), and flattened into arrays so that a batch of documents descends
all trees in numpy.

Defined cases: null and empty texts have statistics of zero and a score like
any other; repeated rows score alike; without labels, or with labels of one
class, every score is the share of ones (0.5 without labels); null labels are
left out, contradicting ones of an id count as their majority, ties as 1; an
empty table gives an empty result. Ids, language and source are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole_text

#: Labelled rows that training reads at most.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 32, 0.2, 20, 1.0

STATISTICS = ("log_chars", "log_words", "mean_word", "long_words", "letters", "upper", "digits", "spaces", "newlines", "stops", "marks", "symbols", "high_bytes", "entropy", "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "mean_line", "no_stop_lines", "mark_words", "mean_sentence", "caps_words", "one_char_words")

_CLASS = np.zeros((9, 256), dtype=bool)
_CLASS[0, [*range(65, 91), *range(97, 123)]] = True
_CLASS[1, 65:91] = True
_CLASS[2, 48:58] = True
_CLASS[3, [32, 9, 11, 12, 13]] = True
_CLASS[4, 10] = True
_CLASS[5, [ord(c) for c in ".?!"]] = True
_CLASS[6, [ord(c) for c in ",;:'\"()-"]] = True
_CLASS[7, [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASS[8, 128:] = True
_END = tuple(b".?!\"')")


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = _CLASS @ counts / n
    p = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    pairs = len(set(zip(words, words[1:], strict=False)))
    ends = sum(x.rstrip()[-1] not in _END for x in lines)
    marks = sum(w[-1] < 48 or 57 < w[-1] < 65 for w in words)
    return [
        math.log1p(len(text)), math.log1p(len(words)), float(lengths.sum()) / m, float((lengths > 14).sum()) / m, *share[[0, 1, 2, 3, 4, 5, 6, 7, 8]].tolist(), float(-(p * np.log2(p)).sum()),
        len(seen) / m, max(seen.values(), default=0) / m, 1 - pairs / max(1, len(words) - 1), len(set(lines)) / k, math.log1p(n / k), ends / k, marks / m, m / max(1, int(counts[[33, 46, 63]].sum())), sum(w.isupper() for w in words) / m, float((lengths == 1).sum()) / m,
    ]


def statistics_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: inner nodes by level, then leaves."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = int(math.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            z += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST) -> Forest:
    """Newton boosting of the logistic loss on quantile histograms."""
    inner, leaves = 2**depth - 1, 2**depth
    rate1 = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or rate1 in (0.0, 1.0):
        rate1 = min(max(rate1, 0.01), 0.99)
        return Forest(math.log(rate1 / (1 - rate1)), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    offset = np.arange(x.shape[1]) * bins
    prior = math.log(rate1 / (1 - rate1))
    z = np.full(len(y), prior)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, threshold, cutbin = np.zeros(inner, int), np.full(inner, np.inf), np.full(inner, bins)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (x.shape[1] * bins) + offset + binned).ravel()
            size = width * x.shape[1] * bins
            hist = [np.bincount(cell, weights=np.repeat(v, x.shape[1]), minlength=size).reshape(width, x.shape[1], bins) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (v.cumsum(axis=2)[:, :, :-1] for v in hist)
            gt, ht, nt = (v.sum(axis=2, keepdims=True) for v in hist)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < least) | (nt - nl < least)] = -1
            for node in range(width):
                f, b = np.unravel_index(int(gain[node].argmax()), gain[node].shape)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], threshold[first + node], cutbin[first + node] = f, edges[f][b], b
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > cutbin[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + RIDGE)
        z += value[leaf]
        out.append((feature, threshold, value))
    return Forest(prior, *(np.stack(v) for v in zip(*out, strict=True)))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of ids whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> Forest:
    """A forest fitted on at most ``sample`` labelled documents, chosen by a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_labelled")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    columns = [f"f{k}" for k in range(len(STATISTICS))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(statistics_of(pdf["_text"].tolist()), columns=columns)
            yield out.assign(y=pdf["_y"].to_numpy(), id=pdf["_labelled"].to_numpy())

    # The sample's ids are bounded by the parameter, so they may be broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(known), F.col("_id") == F.col("_labelled")).select("_labelled", "_text", "_y")
    rows = rows.groupBy("_labelled", "_y").agg(F.min("_text").alias("_text"))  # an id labels one text
    got = rows.mapInPandas(run, ", ".join(f"{c} double" for c in columns) + ", y int, id long").toPandas().sort_values("id")
    return fit(got[columns].to_numpy(dtype=np.float64), got["y"].to_numpy(dtype=np.float64))


def score_column(forest: Forest, text_col: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = [forest.score(statistics_of(texts.iloc[k : k + 512].tolist())) for k in range(0, len(texts), 512)]
        return pd.Series(np.concatenate(out) if out else np.array([], dtype=np.float64))

    return score(whole_text(text_col))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    forest = train(docs, labels, id_col, text_col, label_col, sample=sample)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), score_column(forest, text_col).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score reaches a half."""
    forest = train(docs, labels, id_col, text_col, label_col, sample=sample)
    score = fresh(docs, "score")
    return docs.withColumn(score, score_column(forest, text_col)).where(F.col(score) >= 0.5).select(*docs.columns)
