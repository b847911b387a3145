"""Fingerprints hold every anchor, however long the text."""

import numpy as np
from pyspark.sql import functions as F
from test_corpus import rows_of

from biotally.llm import fingerprints, queries


def words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, n)]


def test_long_texts_keep_all_anchors(spark, monkeypatch):
    shared = words(1, 60)
    a, b = words(2, 4000) + shared, shared + words(3, 4000)
    monkeypatch.setattr(queries, "table", lambda *_: rows_of(spark, [" ".join(a), " ".join(b), "one two", None]))
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, "").collect()}
    one, two = ([tuple(x.split(":")) for x in got[k]["fingerprint"].split()] for k in (0, 1))
    assert min(len(one), len(two)) > 1000
    assert [int(p, 16) for p, _ in one] == sorted({int(p, 16) for p, _ in one})
    # What is shared has the same hashes, each at its own place.
    late = {h: int(p, 16) for p, h in one}
    both = [(int(p, 16), late[h]) for p, h in two if h in late]
    assert len(both) >= 15 and all(y - x == 4000 for x, y in both)
    ha, hb = {h for _, h in one}, {h for _, h in two}
    assert got[1]["near_next"] == len(ha & hb) / len(ha | hb) > 0
    assert len(got[2]["fingerprint"].split()) == 1 and got[3]["fingerprint"] == ""
    assert spark.range(1).select(fingerprints.alike(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))).first()[0] == 1
