"""md5 on arrays, and reads' keys that take no row each."""

import hashlib

import numpy as np

from biotally.functions import digests
from biotally.operators import relational


def test_digests_are_those_of_hashlib():
    prefixes = [b"", b"7:a:b:", "7:é:".encode(), *[b"x" * n for n in (1, 44, 45, 53, 54, 55, 56, 63, 64, 200)]]
    numbers = np.array([1, 9, 10, 99, 100, 65536, 10**9, 10**15, 10**18])
    which, i = np.repeat(np.arange(len(prefixes)), len(numbers)), np.tile(numbers, len(prefixes))
    got = digests.numbered(prefixes, which, i)
    assert [x.tobytes() for x in got] == [hashlib.md5(prefixes[w] + b"%d" % n).digest() for w, n in zip(which.tolist(), i.tolist(), strict=True)]


def test_no_read_is_a_row_of_the_plan(spark):
    tab = spark.createDataFrame([("a", "x", 50.0), ("b", "x", 30.0)], "feature string, sample string, value double")
    plan = relational.rarefy(tab, 40, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan


def test_ids_may_be_numbers(spark):
    cells = [(1, 7, 50.0), (2, 7, 30.0), (1, 8, 45.0)]
    as_numbers, as_texts = (relational.rarefy(spark.createDataFrame(cells, "feature long, sample long, value double").selectExpr(f"cast(feature as {k}) feature", f"cast(sample as {k}) sample", "value"), 40, 7).collect() for k in ("long", "string"))
    assert sorted((str(r["feature"]), str(r["sample"]), r["value"]) for r in as_numbers) == sorted((r["feature"], r["sample"], r["value"]) for r in as_texts)
    assert sum(r["value"] for r in as_numbers) == 80
