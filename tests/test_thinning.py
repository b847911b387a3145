"""Draws on counts: their distribution, and their shape on tables."""

import math
from fractions import Fraction

import numpy as np
import pytest

from biotally.operators import relational, thinning


def exact(total, own, n, k):
    return Fraction(math.comb(own, k) * math.comb(total - own, n - k), math.comb(total, n))


@pytest.mark.parametrize(("total", "own", "n"), [(10, 4, 3), (50, 25, 25), (7, 7, 3), (9, 0, 4), (1000, 30, 500), (40, 39, 39), (1, 1, 1), (5000, 2500, 40)])
def test_hypergeometric_by_its_whole_distribution(total, own, n):
    """Evenly spaced numbers hit each value as often as its probability says."""
    m = 20_000
    u = (np.arange(m) + 0.5) / m
    full = lambda v: np.full(m, v)
    got = np.bincount(thinning.hypergeometric(full(total), full(own), full(n), u), minlength=own + 1) / m
    for k in range(max(0, n - total + own), min(n, own) + 1):
        assert got[k] == pytest.approx(float(exact(total, own, n, k)), abs=1.1 / m + 1e-9)
    assert got.sum() == pytest.approx(1)


def test_plain_form_of_the_search():
    rng = np.random.default_rng(4)
    for _ in range(300):
        total = int(rng.integers(1, 60))
        own, n, u = int(rng.integers(0, total + 1)), int(rng.integers(0, total + 1)), float(rng.random())
        low, high = max(0, n - total + own), min(n, own)
        mode = min(max((n + 1) * (own + 1) // (total + 2), low), high)
        order = [mode] + [x for d in range(1, total + 1) for x in (mode + d, mode - d) if low <= x <= high]
        passed = Fraction(0)
        for want in order:
            passed += exact(total, own, n, want)
            if passed >= Fraction(u):
                break
        assert thinning.hypergeometric(*(np.array([x]) for x in (total, own, n)), np.array([u]))[0] == want


def test_large_counts_end():
    got = thinning.hypergeometric(np.array([10**10]), np.array([4 * 10**9]), np.array([10**6]), np.array([0.999999]))
    assert abs(got[0] - 400_000) < 5_000


def test_log_factorials():
    n = np.array([0, 1, 5, 1023, 1024, 1025, 10**6])
    assert np.allclose(thinning.log_factorial(n), [math.lgamma(x + 1) for x in n], rtol=1e-13, atol=1e-12)


def test_halves_add_up():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 40, 30)
    values = rng.integers(1, 50, sizes.sum())
    ends = np.cumsum(sizes)
    totals = np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))
    n = (totals * rng.random(30)).astype(np.int64)
    got = thinning.halved(values, ends, n, [str(k) for k in range(30)])
    assert (got >= 0).all() and (got <= values).all()
    assert (np.add.reduceat(got, np.concatenate([[0], ends[:-1]])) == n).all()


def test_expected_values_and_variances():
    values = np.array([1, 2, 3, 50, 44, 100])
    n, times = 60, 4000
    got = np.array([thinning.halved(values, np.array([6]), np.array([n]), [f"x{k}"]) for k in range(times)])
    total = values.sum()
    mean = n * values / total
    var = mean * (1 - values / total) * (total - n) / (total - 1)
    assert np.allclose(got.mean(axis=0), mean, atol=5 * np.sqrt(var.max() / times))
    assert np.allclose(got.var(axis=0), var, rtol=0.15)
    cov = np.cov(got[:, 3], got[:, 5])[0, 1]
    assert cov == pytest.approx(-n * values[3] * values[5] / total**2 * (total - n) / (total - 1), rel=0.2)


@pytest.fixture(scope="module")
def tab(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{k}", f"s{j}", float(rng.integers(0, 30))) for j in range(4) for k in range(300)] + [("f1", "tiny", 2.0), ("é😀", "s0", 40.7)]
    return spark.createDataFrame(rows, "feature string, sample string, value double").where("value > 0")


def test_rarefy(spark, tab):
    whole = {(r["feature"], r["sample"]): r["value"] for r in tab.collect()}
    sums = {}
    got = relational.rarefy(tab, 1000, 3, method="counts").collect()
    for r in got:
        assert 0 < r["value"] <= math.floor(whole[r["feature"], r["sample"]])
        sums[r["sample"]] = sums.get(r["sample"], 0) + r["value"]
    assert sums == {f"s{j}": 1000 for j in range(4)}
    again = relational.rarefy(tab.repartition(7), 1000, 3, method="counts").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    other = relational.rarefy(tab, 1000, 4, method="counts").collect()
    assert sorted(map(tuple, got)) != sorted(map(tuple, other))
    least = relational.rarefy(tab, "min", 3, method="counts").groupBy("sample").sum("value").collect()
    assert {r[1] for r in least} == {2.0} and len(least) == 5


def test_depths_are_nested(spark, tab):
    depths = spark.createDataFrame([("s0", 10), ("s0", 500), ("s0", 2000), ("s1", 7), ("s2", 0)], "sample string, depth int")
    rows = thinning.drawn(tab, depths, 5).collect()
    by = {}
    for r in rows:
        by.setdefault((r["sample"], r["depth"]), {})[r["feature"]] = r["n"]
    assert {k: sum(v.values()) for k, v in by.items()} == {("s0", 10): 10, ("s0", 500): 500, ("s0", 2000): 2000, ("s1", 7): 7}
    assert all(n <= by["s0", 500][f] for f, n in by["s0", 10].items())
    assert all(n <= by["s0", 2000][f] for f, n in by["s0", 500].items())


def test_curves_agree_on_average(tab):
    """Richness at a depth, by either method, around its expectation."""
    values = [int(r["value"]) for r in tab.where("sample = 's1'").collect()]
    total = sum(values)
    step = total // 20
    want = sum(1 - math.comb(total - v, step) / math.comb(total, step) for v in values)
    for method in ("reads", "counts"):
        got = [r["d"] for seed in range(4) for r in relational.rarefaction_curve(tab.where("sample = 's1'"), 0, seed, method=method).where(f"depth = {step}").collect()]
        assert np.mean(got) == pytest.approx(want, rel=0.1)


def test_empty(tab):
    assert relational.rarefy(tab.limit(0), 5, method="counts").collect() == []
    with pytest.raises(ValueError):
        relational.rarefy(tab, 5, method="none")


def test_first_reads_of_one_order():
    """Nested counts of each depth, with the distribution of draws without replacement."""
    counts, depths = np.array([1, 2, 3, 50, 44, 100]), np.array([10, 60, 200])
    got = np.array([thinning.firsts(counts, depths, f"x{k}") for k in range(3000)])
    assert (got.sum(axis=2) == depths).all() and (got[:, 2] == counts).all() and (np.diff(got, axis=1) >= 0).all()
    total = counts.sum()
    mean = 60 * counts / total
    var = mean * (1 - counts / total) * (total - 60) / (total - 1)
    assert np.allclose(got[:, 1].mean(axis=0), mean, atol=5 * np.sqrt(var.max() / 3000))
    assert np.allclose(got[:, 1].var(axis=0), var, rtol=0.15)


@pytest.mark.parametrize("whole", [1 << 20, 4300, 0])
def test_small_samples_take_one_row(spark, tab, monkeypatch, whole):
    """Samples above the bound go by parts, and none else does; draws of either keep their sums."""
    monkeypatch.setattr(thinning, "WHOLE", whole)
    reads = {r["sample"]: r["n"] for r in tab.selectExpr("sample", "floor(value) v").groupBy("sample").agg({"v": "sum"}).toDF("sample", "n").collect()}
    depths = spark.createDataFrame([(s, d) for s in reads for d in (1, 2, 1000, reads[s]) if d <= reads[s]], "sample string, depth long")
    rows = thinning.drawn(tab, depths, 5)
    by = {}
    for r in rows.collect():
        by.setdefault((r["sample"], r["depth"]), {})[r["feature"]] = r["n"]
    assert {k: sum(v.values()) for k, v in by.items()} == {(r["sample"], r["depth"]): r["depth"] for r in depths.collect()}
    for s, n in reads.items():
        assert by[s, n] == {r["feature"]: math.floor(r["value"]) for r in tab.where(f"sample = '{s}'").collect() if r["value"] >= 1}
        assert all(x <= by[s, n][f] for f, x in by[s, 2].items())


def test_one_pass_for_small_samples(spark, tab):
    depths = spark.createDataFrame([("s0", 10), ("s0", 500)], "sample string, depth long")
    plan = thinning.drawn(tab, depths, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "md5" not in plan  # two levels of parts before
