"""Queries read their whole tables, and parts of the engine against brute force."""

import itertools
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import beta
from biotally.plans import ORACLES, QUERIES
from biotally.plans.fixtures import tab_wide

SF = "/root/testdata/sf0.001"


def test_nothing_is_left_out(spark):
    """No condition on ids in any fixture; the rows of a plain query are all rows."""
    text = Path(beta.__file__).parents[1].joinpath("plans", "fixtures.py").read_text()
    assert not re.search(r" % \d+ = 0\W*(GROUP|\))|limit\(|sample\(", text)
    got = {(r["feature"], r["sample"]) for r in QUERIES["rel_abundance"](spark, SF).collect()}
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect()
    assert got == {(str(a), str(b)) for a, b in li}
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    for name in ("seq_distance", "seq_distance_banded"):
        assert QUERIES[name](spark, SF).count() == n * (n - 1) // 2
    assert not [q for q in ORACLES.values() if re.search(r"l_partkey %|l_suppkey <=|CAST\(leaf AS INT\) %", q)]


def table_of(rng, features, samples, dense):
    """Features that all samples hold, and features that two hold."""
    rows = []
    for f in range(features):
        own = range(samples) if f < dense else rng.choice(samples, 2, replace=False)
        rows += [(f"f{f}", f"s{int(s)}", float(rng.integers(1, 50))) for s in own]
    return rows


def shares(rows):
    p = {}
    for f, s, v in rows:
        p.setdefault(s, {})[f] = v
    return {s: {f: v / sum(x.values()) for f, v in x.items()} for s, x in p.items()}


def test_pairs_against_brute_force(spark):
    rows = table_of(np.random.default_rng(2), 40, 21, 6)
    tab = spark.createDataFrame(rows, "feature string, sample string, value double")
    p = shares(rows)
    pairs = list(itertools.combinations(sorted(p), 2))
    want = {(a, b): 1 - sum(min(v, p[b].get(f, 0)) for f, v in p[a].items()) for a, b in pairs}
    assert {(r["s1"], r["s2"]): r["value"] for r in beta.bray(tab).collect()} == pytest.approx(want, abs=1e-12)
    want = {(a, b): 1 - len(p[a].keys() & p[b].keys()) / len(p[a].keys() | p[b].keys()) for a, b in pairs}
    assert {(r["s1"], r["s2"]): r["value"] for r in beta.jaccard(tab).collect()} == pytest.approx(want, abs=1e-12)

    def number(x, q):
        x = np.array([v for v in x if v > 0])
        return np.exp(-(x * np.log(x)).sum()) if q == 1 else (x**q).sum() ** (1 / (1 - q))

    for q in (0, 1, 2):
        want = {}
        for a, b in pairs:
            every = p[a].keys() | p[b].keys()
            gamma = number([(p[a].get(f, 0) + p[b].get(f, 0)) / 2 for f in every], q)
            if q == 1:
                alpha = np.exp(sum(np.log(number(p[s].values(), 1)) for s in (a, b)) / 2)
            else:
                alpha = (sum((np.array(list(p[s].values())) ** q).sum() for s in (a, b)) / 2) ** (1 / (1 - q))
            want[a, b] = gamma / alpha
        got = {(r["s1"], r["s2"]): r["value"] for r in beta.naive_beta(tab, q, dis=False).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_objects_have_all_suppliers(spark):
    have = {r[0] for r in tab_wide(spark, SF).select("sample").distinct().collect()}
    got = {r["sample"].rsplit("_", 1)[0] for r in QUERIES["merge_objects"](spark, SF).select("sample").distinct().collect()}
    assert got == have == {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select(F.col("s_suppkey").cast("string")).collect()}
