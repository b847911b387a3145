"""Near-copies against brute force over all pairs, and planted ones."""

import collections

import numpy as np
from test_corpus import rows_of

import corpus_pipeline
from biotally.llm import simhash

SF = "/root/testdata/sf0.001"


def sets_of(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in split]


def kept_by_brute_force(ids, texts):
    s = sets_of(texts)
    root = list(range(len(s)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a] == s[b] or len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values())


def test_planted_near_copies(spark):
    rng = np.random.default_rng(5)
    texts = []
    for n in range(40):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
        texts.append(" ".join(words))
        for at in rng.choice(np.arange(10, 190), 1 + n % 4, replace=False):
            words[at] = "edited"
        texts.append(" ".join(words))
    texts += [None, "", "one two", "One  two", "one two three"]
    out = corpus_pipeline.drop_near_duplicates(spark, rows_of(spark, texts), SF)
    want = kept_by_brute_force(range(len(texts)), texts)
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert want[:40] == list(range(0, 80, 2))


def test_real_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == kept_by_brute_force([r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_large_groups_are_cut(spark, monkeypatch):
    """Blocks of few shingles, and runs too long to hold, link the same."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(simhash, "HELD", 3)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]
    texts = []
    for k in range(60):
        words = list(base) if k % 3 else [f"v{x}" for x in rng.integers(0, 1 << 40, 120)]
        words[k] = f"edit{k}"
        if k % 5 == 0:
            words[100 - k] = "more"
        texts.append(" ".join(words))
    got = collections.defaultdict(set)
    for r in simhash.near_copies(rows_of(spark, texts)).collect():
        got[r["component_id"]].add(r["doc_id"])
    assert sorted(got) == kept_by_brute_force(range(60), texts) and len(got[1]) == 40
