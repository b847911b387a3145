"""Matrices whose blocks are made from the table, without a row a pair."""

import numpy as np

from biotally.operators import beta, blocked, pairwise


def test_as_by_rows(spark):
    rng = np.random.default_rng(2)
    cells = [(f"f{i}", f"s{j}", float(rng.integers(1, 30))) for i in range(40) for j in range(17) if rng.random() < 0.4]
    tab = spark.createDataFrame([*cells, ("f1", "none", 0.0)], "feature string, sample string, value double").cache()
    meta = spark.createDataFrame([(f"s{j}", "xyz"[j % 3]) for j in range(17)], "sample string, grp string")
    rows = beta.bray(tab)

    def none(_):
        raise AssertionError("a row a pair")

    pairs = pairwise.Pairs(tab, pairwise.bray(), none)
    one, two = (blocked.blocked(x, 6) for x in (pairs, rows))
    want = {(r["i"], r["j"]): np.frombuffer(r["data"]) for r in two.cells.collect()}
    found = {(r["i"], r["j"]): np.frombuffer(r["data"]) for r in one.cells.collect()}
    assert one.n == two.n == 17 and set(found) == set(want) and len(want) == 6
    for k, v in want.items():
        np.testing.assert_allclose(found[k], v, atol=1e-12)
    assert abs(one.grand - two.grand) < 1e-12
    a, b = (blocked.permanova(x, meta, "grp", n=19, seed=3, size=6).collect() for x in (pairs, rows))
    for x, y in zip(a, b, strict=True):
        assert x["term"] == y["term"] and x["p"] == y["p"]
        np.testing.assert_allclose(x["ss"], y["ss"], atol=1e-9)


def test_alike_pairs_take_little():
    x = np.full((1024, 1024), -0.5)
    assert len(blocked._compressed(x)) < x.nbytes / 100
    assert np.array_equal(blocked._block(blocked._compressed(x), 1024, 1024), x)
