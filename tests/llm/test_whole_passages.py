"""Passages with short lines, short copies, and passages pasted anywhere."""

import numpy as np
from test_corpus import rows_of

from biotally.llm import substring


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


def removed(spark, texts):
    out = {}
    for r in substring.repeats(rows_of(spark, texts)).collect():
        out.setdefault(r["doc_id"], []).append(texts[r["doc_id"]][r["start"] : r["end"]])
    return out


def test_short_lines(spark):
    rng = np.random.default_rng(3)
    verse = words(rng, 60)
    lines = "\n".join(" ".join(verse[k : k + 4]) for k in range(0, 60, 4))
    texts = ["\n".join([" ".join(words(rng, 5)), lines]), "\n".join([lines, " ".join(words(rng, 5))]), "a b\nc d e", "a b\nc d e"]
    got = removed(spark, texts)
    assert set(got) == {1, 3}
    assert sum(len(x.split()) for x in got[1]) == 60 and sum(len(x.split()) for x in got[3]) == 5


def test_pasted_passages(spark):
    rng = np.random.default_rng(4)
    texts, passages = [], []
    for k in range(50):
        p = words(rng, 50 + k % 20)
        passages.append(set(p))
        for _ in range(2):  # line ends elsewhere in each text
            w = words(rng, 40)
            at = int(rng.integers(0, 40))
            w = [*w[:at], *p, *w[at:]]
            texts.append("".join(x + ("\n" if rng.random() < 0.2 else " ") for x in w))
    got = removed(spark, texts)
    assert set(got) == set(range(1, 100, 2))
    gone = [{x for part in got[2 * k + 1] for x in part.split()} for k in range(50)]
    assert all(g <= p for g, p in zip(gone, passages, strict=True))
    share = sum(map(len, gone)) / sum(map(len, passages))
    print(f"words removed: {share:.3f}")
    assert share > 0.7


def test_every_repeated_line_goes(spark):
    """A segmenter of its own: split at line feeds, squeeze, lower-case."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    gone = {}
    for r in substring.repeats(docs).collect():
        gone.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
        assert min(r["first_doc_ids"]) == r["first_doc_id"] and r["first_doc_ids"] == sorted(set(r["first_doc_ids"]))
    first, repeats = {}, 0
    for r in docs.orderBy("doc_id").collect():
        text, at = r["text"] or "", 0
        for line in text.split("\n"):
            unit = " ".join(line.split()).lower()
            if unit and first.setdefault(unit, (r["doc_id"], at)) != (r["doc_id"], at):
                repeats += 1
                own = line.strip()
                start = at + line.index(own)
                assert gone[r["doc_id"]] >= set(range(start, start + len(own)))
            at += len(line) + 1
    assert repeats > 50


def test_odd_tables(spark):
    docs = rows_of(spark, [None, "", "a\na\nb", "b", None])
    assert substring.without_repeats(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: (r["text"], [tuple(x)[:2] for x in r["removed"] or []]) for r in substring.without_repeats(docs).collect()}
    assert kept == {0: (None, []), 1: ("", []), 2: ("a\n\nb", [(2, 3)]), 3: ("", [(0, 1)]), 4: (None, [])}
