"""Units of blocks of texts against plain loops, one text and one word at a time."""

import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F
from test_corpus import ODD, rows_of

from biotally.llm import substring

SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?![\s])[^\n.!?]*)*[.!?]*")
FRAGMENT = re.compile(r"(?<=\s)(?=[^\W\d_a-zß-öø-ÿ])")


def plain_runs(text, least):
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    if len(words) < least:
        return
    raw = [text[a:b].encode() for a, b in words]
    low = " ".join(x.decode() for x in raw).lower().encode().split(b" ")
    h = [zlib.crc32(a + b) for a, b in zip(low, low[1:], strict=False)]
    edges = {0, len(words)}
    for k in range(len(h) - substring.WINDOW + 1):
        part = h[k : k + substring.WINDOW]
        edges.add(k + part.index(min(part)) + 2)
    pairs = set()
    for a in edges:
        pairs |= {(a, min(b for b in edges if b - a >= least))} if any(b - a >= least for b in edges) else set()
        pairs |= {(max(b for b in edges if a - b >= least), a)} if any(a - b >= least for b in edges) else set()
    for a, b in sorted(pairs):
        yield words[a][0], words[b - 1][1]


def plain_spans(text, least):
    yield from plain_runs(text, least)
    for m in re.finditer(r"[^\n]+", text):
        if m[0].split():
            yield m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())
    for m in SENTENCE.finditer(text):
        if len(m[0].split()) >= least:
            start, end = m.start() + len(m[0]) - len(m[0].lstrip()), m.start() + len(m[0].rstrip())
            yield start, end
            cuts = [x.start() for x in FRAGMENT.finditer(text, start + 1, end)]
            for a, b in zip([start, *cuts], [*cuts, end], strict=True):
                if len(text[a:b].split()) >= least:
                    yield a, a + len(text[a:b].rstrip())


def plain(text, least):
    """Each unit once, where it is met first."""
    return [(a, b, len(text[a:b].split()), " ".join(text[a:b].split()).lower()) for a, b in dict.fromkeys(plain_spans(text, least))]


def odd_texts(n):
    rng = random.Random(5)
    tokens = ["a", "B", "Ab", "Σ", "ΑΣ", "ΑΣ.", "Σ́", "İx", "ß", "Éa", "éa", "x.", "y!?", "...", ".z", "z.Q", "1", "_", "Ünder", "日本", "ǅa", "𝐀x", "q...r.", "don't"]
    spaces = [" ", " ", " ", "\n", " \n ", "\t", " ", "\x1c", "\r\n", "\x85", " ", ".\n", "  "]
    for _ in range(n):
        yield "".join(rng.choice(tokens) + rng.choice(spaces) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 16, 17, 18, 40, 120])))


@pytest.fixture(scope="module")
def real(spark):
    return [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.mark.parametrize("least", [1, 3, substring.LEAST, 30])
def test_blocks_against_plain_loops(real, least, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 5000)
    texts = ["", *odd_texts(400), *[t or "" for t in ODD if len(t or "") < 6000], *[t for t in real if len(t) < 6000], "", " \n"]
    got, blocks = [[] for _ in texts], list(substring._blocks(texts))
    for block in blocks:
        home, starts, ends, words, taken = substring.block_units(texts[block], least)
        for k, *span, unit in zip(home.tolist(), starts.tolist(), ends.tolist(), words.tolist(), taken, strict=True):
            got[block.start + k].append((*span, unit.decode()))
    assert len(blocks) > 10 and [k for b in blocks for k in range(b.start, b.stop)] == list(range(len(texts)))
    for text, units in zip(texts, got, strict=True):
        assert units == plain(text, least) and units == list(substring.text_units(text, least))


def test_units_rows(spark):
    texts = ["A line.\nof three\nA  LINE.", None, "", "of three\nof four"]
    docs = rows_of(spark, texts).coalesce(1).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id") + F.lit((1 << 53) - 2)))
    rows = {(r["doc_id"], r["start"]): r for r in substring.units(docs).collect()}
    last = (1 << 53) + 1
    assert {k: (r["end"], r["words"], r["again"]) for k, r in rows.items()} == {(None, 0): (7, 2, None), (None, 8): (16, 2, None), (None, 17): (25, 2, 0), (last, 0): (8, 2, None), (last, 9): (16, 2, None)}
    assert rows[None, 8][5:7] == rows[last, 0][5:7] and rows[None, 0][5:7] == rows[None, 17][5:7] != rows[last, 9][5:7]


def test_seconds_of_units(spark):
    """One long text takes less than 2.8 times what scanning it for the same
    marks takes (1.6 times as measured; 5.2 with a pattern and a loop a unit)."""
    text = "\n".join(r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())

    def scans():
        for m in SENTENCE.finditer(text):
            for _ in FRAGMENT.finditer(text, m.start(), m.end()):
                pass
        for _ in re.finditer(r"\S+", text):
            pass

    def seconds(run):
        spent = []
        for _ in range(3):
            at = time.process_time()
            run()
            spent.append(time.process_time() - at)
        return min(spent)

    ours, theirs = seconds(lambda: list(substring.text_units(text))), seconds(scans)
    print(f"units {ours:.2f} s, scans {theirs:.2f} s")
    assert ours < 2.8 * theirs
