"""Raup-Crick by arrays: against plain loops over the same draws, and the draws
against the distribution of those by md5 keys."""

import numpy as np
import pytest

from biotally.operators import beta, drawn, nulls

KINDS = {"bray": drawn.bray, "jaccard": drawn.jaccard, "naive": drawn.naive(1)}


@pytest.fixture(scope="module")
def community(spark):
    rng = np.random.default_rng(8)
    cells = [(f"f{i:02}", f"s{j}", float(rng.integers(1, 30))) for i in range(20) for j in range(9) if rng.random() < 0.4]
    cells += [("f00", "lone", 1.0), ("apart", "other", 4.0)]
    tab = spark.createDataFrame(cells, "feature string, sample string, value double").cache()
    groups = spark.createDataFrame([(s, "x" if k % 3 else "y") for k, s in enumerate(sorted({c[1] for c in cells}))], "sample string, grp string")
    return tab, groups.cache()


def dense(tab):
    cells = [tuple(r) for r in tab.collect()]
    features, samples = (sorted({c[k] for c in cells}) for k in (0, 1))
    x = np.zeros((len(features), len(samples)))
    for f, s, v in cells:
        x[features.index(f), samples.index(s)] = v
    return features, samples, x


def pools_of(x, samples, group, weight):
    out = {}
    for g in set(group.values()):
        own = x[:, [group[s] == g for s in samples]]
        codes = np.flatnonzero(own.sum(axis=1))
        abundance, frequency = own.sum(axis=1)[codes], (own > 0).sum(axis=1)[codes].astype(float)
        out[g] = (codes, abundance, frequency if weight == "frequency" else abundance)
    return out


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("weight", ["frequency", "abundance"])
def test_plain_loops(spark, community, kind, weight):
    tab, groups = community
    _, samples, x = dense(tab)
    group = {r["sample"]: r["grp"] for r in groups.collect()}
    pools, n = pools_of(x, samples, group, weight), 70  # more than a chunk
    null = [KINDS[kind](t, t) for it in range(1, n + 1) for t in [drawn.draw(x, samples, [group[s] for s in samples], pools, 2, it)]]
    got = {(r["s1"], r["s2"]): r for r in nulls.rcq(tab, kind, 1, n, groups, weight, 2, arrays=True).collect()}
    small = {(r["s1"], r["s2"]): r for r in drawn.against_null(nulls._whole_counts(tab, groups), nulls._pool(nulls._whole_counts(tab, groups)).withColumnRenamed(weight, "weight").withColumn("abundance", nulls.F.col("weight") if weight == "abundance" else nulls.F.col("abundance")), KINDS[kind], n, 2, block=4).collect()} if kind == "naive" else got
    how = {"bray": beta.bray, "jaccard": beta.jaccard, "naive": beta.naive_beta}[kind]
    want = {(r["s1"], r["s2"]): r["value"] for r in how(tab).collect()}
    assert set(got) == set(small) == set(want) and len(want) == 55
    for (a, b), obs in want.items():
        i, j = samples.index(a), samples.index(b)
        v = [d[i, j] for d in null]
        p = sum((round(u, 10) < round(obs, 10)) + 0.5 * (round(u, 10) == round(obs, 10)) for u in v) / n
        for r in (got[a, b], small[a, b]):
            np.testing.assert_allclose([r["obs"], r["null_mean"], r["null_std"], r["p"]], [obs, np.mean(v), np.std(v, ddof=1), p], atol=1e-9)


@pytest.mark.parametrize("q", [0, 0.5, 2])
def test_orders(community, q):
    tab, _ = community
    _, samples, x = dense(tab)
    d = drawn.naive(q)(x, x)
    for r in beta.naive_beta(tab, q).collect():
        assert abs(d[samples.index(r["s1"]), samples.index(r["s2"])] - r["value"]) < 1e-9


def test_distribution(community):
    """Richness and reads are kept; means are those of tables by md5 keys."""
    tab, groups = community
    features, samples, x = dense(tab)
    group = {r["sample"]: r["grp"] for r in groups.collect()}
    pools, n = pools_of(x, samples, group, "frequency"), 400
    tables = [drawn.draw(x, samples, [group[s] for s in samples], pools, 1, it) for it in range(1, n + 1)]
    for t in tables:
        assert ((t > 0).sum(axis=0) == (x > 0).sum(axis=0)).all() and (t.sum(axis=0) == x.sum(axis=0)).all()
    other = np.zeros((2, *x.shape))
    for r in nulls.random_tables(tab, n, 1, groups).collect():
        at = features.index(r["feature"]), samples.index(r["sample"])
        other[0][at] += r["value"]
        other[1][at] += 1
    counts = np.stack(tables)
    spread = np.sqrt(counts.var(axis=0) / n * 2) + 1e-9
    assert (np.abs(counts.mean(axis=0) - other[0] / n) < 5 * spread).all()
    assert (np.abs((counts > 0).mean(axis=0) - other[1] / n) < 0.18).all()


def test_cases(spark, community):
    tab, groups = community
    assert nulls.rcq(tab.limit(0), "bray", n=3, arrays=True).collect() == []
    nameless = tab.unionByName(spark.createDataFrame([(None, "s1", 2.0), ("f01", None, 1.0)], tab.schema))
    assert sorted(map(tuple, nulls.rcq(nameless, "bray", n=3, arrays=True).collect())) == sorted(map(tuple, nulls.rcq(tab, "bray", n=3, arrays=True).collect()))
    for bad in ({"div_type": "phyl"}, {"div_type": "bray", "randomization": "x"}, {"div_type": "bray", "n": 0}):
        with pytest.raises(ValueError):
            nulls.rcq(tab, **({"n": 2} | bad), arrays=True)
    with pytest.raises(Exception, match="whole"):
        nulls.rcq(tab.withColumn("value", nulls.F.col("value") + 0.5), "bray", n=2, arrays=True).collect()


def test_blocks_do_not_shrink_with_features(spark):
    """A block has samples by their cells, not by all features, and is not copied."""
    seen = []
    real = drawn.settled
    tab = spark.range(60000).select(drawn.F.concat(drawn.F.lit("f"), "id").alias("feature"), drawn.F.concat(drawn.F.lit("s"), (drawn.F.col("id") % 40)).alias("sample"), drawn.F.lit(2.0).alias("value"))
    drawn.settled = lambda df: seen.append(df) or real(df)
    try:
        assert nulls.rcq(tab, "jaccard", n=2, arrays=True).count() == 780
    finally:
        drawn.settled = real
    assert seen[-1].columns == ["block", "rows"] and seen[-1].count() == 1


def test_draws_of_a_few_of_many(spark):
    """Drawn one by one as by keys: how often each of two weights is taken."""
    n, pool = 3000, (np.arange(40), np.ones(40), np.where(np.arange(40) < 4, 8.0, 1.0))
    taken = sum(np.bincount(drawn._draw_one(4, 9, pool, f"{k}")[0], minlength=40) for k in range(n)) / n
    rng = np.random.default_rng(0)
    keys = sum(np.bincount(np.argsort(rng.standard_exponential(40) / pool[2])[:4], minlength=40) for _ in range(n)) / n
    assert abs(taken[:4].mean() - keys[:4].mean()) < 0.03 and abs(taken[4:].mean() - keys[4:].mean()) < 0.01
