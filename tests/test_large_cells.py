"""Thinning of cells of many reads: several depths a part, chunks of a cell, and
each read made once for all depths."""

import hashlib
from collections import Counter

import pytest

from biotally.operators import relational

TAB = "feature string, sample string, value double"


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_first_reads_are_those_of_the_sorted_keys(spark, monkeypatch, chunk):
    monkeypatch.setattr(relational, "CHUNK", chunk)
    cells = [("a", "x", 900.0), ("b", "x", 300.5), ("c", "x", 1.0), ("a", "y", 3.0), ("b", "z", 0.4)]
    depths = [("x", d) for d in (1, 2, 3, 5, 600, 601, 1200, 1201)] + [("y", 3), ("y", 0)]
    got = {tuple(r)[:3]: r["n"] for r in relational.first_reads(spark.createDataFrame(cells, TAB), spark.createDataFrame(depths, "sample string, depth long"), 5).select("sample", "depth", "feature", "n").collect()}
    want = {}
    for s, d in depths:
        keys = sorted((hashlib.md5(f"5:{s}:{f}:{i}".encode()).hexdigest(), f, i) for f, t, v in cells if t == s for i in range(1, int(v) + 1))
        want |= {(s, d, f): float(n) for f, n in Counter(f for _, f, _ in keys[:d]).items()}
    assert got == want


def test_a_small_table_of_many_reads_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "TASK", 1000)
    monkeypatch.setattr(relational, "CHUNK", 100)
    chunks, tasks = relational._dealt(spark.createDataFrame([("a", "x", 50000.0)], TAB))
    assert tasks == 50 and sum(1 for n in chunks.rdd.glom().map(len).collect() if n) > 20
