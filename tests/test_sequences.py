"""Containment, similarity and banded edits against plain loops; global orders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import combine, relational, sequences


def edits(s, t, band=None):
    n, m = len(s), len(t)
    width = n + m if band is None else max(band, abs(n - m))
    far = n + m + 1
    row = [j if j <= width else far for j in range(m + 1)]
    for i in range(1, n + 1):
        new = [i if i <= width else far] + [far] * m
        for j in range(max(1, i - width), min(m, i + width) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (s[i - 1] != t[j - 1]))
        row = new
    return row[m]


def drawn(seed, n=120, letters="ACGT", longest=24):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n - len(base)):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                s.insert(at, rng.choice(letters))
            elif s and at < len(s):
                if kind == 1:
                    del s[at]
                else:
                    s[at] = rng.choice(letters)
        out.append("".join(s))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containments(spark, seed):
    texts = sorted({*drawn(seed), "", "A", "é😀é", "😀", "A" * 70, "A" * 33, "ACGT" * 20})
    rng = random.Random(seed)
    for s in list(texts):
        if len(s) > 3:
            texts.append(s[rng.randrange(3) : len(s) - rng.randrange(3)])
    texts = sorted(set(texts))
    got = sequences.containments(spark.createDataFrame(list(enumerate(texts)), "id long, seq string")).collect()
    want = {(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts) if i != j and s in t}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


@pytest.mark.parametrize(("seed", "k"), [(1, 0), (2, 1), (3, 2), (4, 3), (5, 5)])
def test_similar(spark, seed, k):
    texts = [*drawn(seed, 150), "", "", "A", "AC", "é", "éé", None, "ACGTACGT", "ACGTACGT"]
    got = sequences.similar(spark.createDataFrame([(f"f{i:03d}", t) for i, t in enumerate(texts)], "feature string, seq string"), k).collect()
    want = {}
    for i, s in enumerate(texts):
        for j in range(i + 1, len(texts)):
            d = edits(s or "", texts[j] or "")
            if d <= k:
                want[f"f{i:03d}", f"f{j:03d}"] = d
    assert {(r["f1"], r["f2"]): r["distance"] for r in got} == want
    assert len(got) == len(want)
    for r in got:
        longer = max(len(texts[int(r["f1"][1:])] or ""), len(texts[int(r["f2"][1:])] or ""))
        assert r["normalized"] == pytest.approx(r["distance"] / longer if longer else 0.0)


def test_segments(spark):
    for k in (0, 1, 2, 5):
        for n in range(k + 1, 20):
            got = spark.range(1).select(*[F.struct(a, w) for a, w in sequences._segments(F.lit(n), k)]).first()
            assert "".join("x" * s[1] for s in got) == "x" * n
            assert [s[0] for s in got] == list(np.cumsum([0] + [s[1] for s in got])[:-1])
            assert max(s[1] for s in got) - min(s[1] for s in got) <= 1


@pytest.mark.parametrize("band", [0, 1, 3, 12])
def test_banded(band):
    texts = [*drawn(9, 60), "", "é😀", "A" * 40]
    one, two = [s for s in texts for _ in texts], texts * len(texts)
    assert sequences.banded(one, two, band).tolist() == [edits(s, t, band) for s, t in zip(one, two, strict=True)]


def plain_names(objects):
    """Naming by a loop over all sequences known so far."""
    names, longest, known, count = {}, {}, [], 0
    for k, seqs in enumerate(objects):
        fresh = []
        for s in seqs:
            if s in names:
                continue
            held = next((t for t in known if s in t or t in s), None) if k else None
            if held is None:
                count += 1
                names[s] = f"SV{count}"
                longest[names[s]] = s
                fresh.append(s)
            else:
                names[s] = names[held]
                if len(s) > len(longest[names[s]]):
                    longest[names[s]] = s
        known += fresh
    return {(s, n, longest[n]) for s, n in names.items()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_names_of_objects_of_different_lengths(spark, seed):
    rng = random.Random(seed)
    base = [s for s in drawn(seed, 40, "AC", 14) if s]
    objects = []
    for _ in range(4):
        seqs = []
        for s in rng.sample(base, 25):
            a, b = rng.randrange(3), rng.randrange(3)
            seqs.append(s[a : len(s) - b] or s)
        objects.append(list(dict.fromkeys(seqs)))
    frames = [{"seq": spark.createDataFrame([(f"otu{i + 1}", s) for i, s in enumerate(o)], "feature string, seq string")} for o in objects]
    got = {tuple(r) for r in combine.sequence_names(frames, different_lengths=True).select("seq", "new", "canonical").collect()}
    assert got == plain_names(objects)


def test_global_order(spark):
    rng = random.Random(6)
    values = [(rng.choice(["a1", "a10", "a2", "B3", None, "é", "a1"]), rng.randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(values, "name string, v int, id int").repartition(9)
    got = {r["id"]: r["n"] for r in relational.numbered(df, "n", F.desc("v"), "id").collect()}
    want = {i: k + 1 for k, (_, _, i) in enumerate(sorted(values, key=lambda x: (-x[1], x[2])))}
    assert got == want
    assert relational.numbered(df.limit(0), "n", "id").collect() == []
    names = relational.with_order(df.select(F.col("name").alias("feature")).where("feature is not null")).collect()
    assert [r["feature"] for r in sorted(names, key=lambda r: r["ord"])] == ["a1", "a2", "a10", "B3", "é"]


def test_average_ranks(spark):
    rng = random.Random(8)
    values = [(i, float(rng.randrange(7))) for i in range(300)]
    df = spark.createDataFrame(values, "id int, v double")
    got = {r["id"]: r["k"] for r in relational.average_ranks(df, "v", "k", "id").collect()}
    for i, v in values:
        assert got[i] == sum(x < v for _, x in values) + (sum(x == v for _, x in values) + 1) / 2


def test_no_window_holds_a_table():
    """Windows without a partition are gone from what orders growing tables (the
    one left in ``statistics`` is over pairs of a table's columns)."""
    import inspect

    for module in (relational, combine):
        assert "over(Window.orderBy" not in inspect.getsource(module)
