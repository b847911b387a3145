"""Phrase collocations against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from biotally.llm import collocations as C

DOCS = "doc_id long, text string, lang string, phrase string, n long, chunk int, words int"


def brute(rows, least, longest, keep, within=80):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {key: a for key, a in f.items() if a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in f.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(inside[lang, w[i : i + m]], a)
    found = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < within * a:
            score, _, left, right = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in found.items() for k, x in enumerate(sorted(xs)[:keep]))


def rows(spark, texts):
    return spark.createDataFrame([(k, t, lang, "x", 1, 2, 3) for k, (t, lang) in enumerate(texts)], DOCS)


def drawn(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "b", "the", "é", "É", "x y", "K", "İ", "\x1c", "😀", "of-it", "\x00"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]
    return [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["en", "en", "en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "least", "longest", "keep", "buckets"), [(1, 5, 4, 2000, None), (2, 30, 4, 7, 8), (3, 1, 3, 50, 1 << 14), (4, 12, 5, 2000, 64), (5, 300, 2, 9, None)])
def test_against_plain_counts(spark, seed, least, longest, keep, buckets):
    texts = [*drawn(seed), (None, "en"), ("", None), ("the the the the the " * 400, "en"), ("one two three, " * 50, None), ("one two three, " * 50, "und")]
    got = C.collocations(rows(spark, texts), least=least, longest=longest, keep=keep, buckets=buckets)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(texts, least, longest, keep)


def test_long_texts_are_read_in_blocks(spark, monkeypatch):
    """A text that is cut between pieces counts as one; so does a piece longer than a block."""
    text = "alpha beta gamma. " * 300 + "delta epsilon " * 500
    got = b"".join(C._blocks([text.encode(), b"", b"Tail"]))
    monkeypatch.setattr(C, "BLOCK", 64)
    parts = list(C._blocks([text.encode(), b"", b"Tail"]))
    assert b"".join(parts) == got
    assert all(p.startswith(b"\n") for p in parts[1:])
    assert max(map(len, parts)) > 64  # the piece without an end
    counts = collections.Counter()
    for p in parts:
        words, piece = C.pieces_of(p)
        counts.update((a, b) for a, b, i, j in zip(words, words[1:], piece, piece[1:]) if i == j)
    assert counts[b"alpha", b"beta"] == 300
    assert counts[b"delta", b"epsilon"] == 500
    assert counts[b"epsilon", b"delta"] == 499


def test_held_phrases_are_handed_over(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 3)
    state = C._Pass(1, 0, None, None)
    state.read("en", b"a b c d e a")
    assert state.size == 5
    out = [r for b in state.phrases() for r in b.to_pylist()]
    assert {r["phrase"]: r["n"] for r in out} == {"a": 2, "b": 1, "c": 1, "d": 1, "e": 1}
    assert state.size == 0


def test_empty_tables(spark):
    assert C.collocations(rows(spark, [])).collect() == []
    assert C.collocations(rows(spark, [(None, None), (" \t\n", "en")])).collect() == []


def test_scores_pass_64_bits(spark):
    """2000000 a is formed in decimals."""
    a = 1 << 50
    got = spark.sql(f"select cast(2000000 as decimal(8,0)) * cast({a} as decimal(19,0)) div (cast({a} as decimal(19,0)) + cast({a} as decimal(19,0))) as s").first()[0]
    assert got == 1_000_000


def test_bitmaps_hold_every_member():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    cells = np.zeros(1 << 14, dtype=np.uint8)
    cells[(hashes & np.uint64((1 << 14) - 1)).astype(np.int64)] = 1
    assert C._held(np.packbits(cells), hashes).all()
    assert not C._held(np.packbits(1 - cells), hashes).any()
