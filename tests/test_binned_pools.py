"""Raup-Crick with pools that are too large to be sent to every task."""

import numpy as np
import pytest

from biotally.operators import drawn, nulls


@pytest.mark.parametrize("kind", ["bray", "jaccard", "naive"])
@pytest.mark.parametrize("most, stored", [(1, 40), (30, 300)])
def test_pools_in_bins(spark, monkeypatch, kind, most, stored):
    """The same draws as with pools in every task."""
    rng = np.random.default_rng(4)
    cells = [(f"f{i}", f"s{j}", float(rng.integers(1, 20))) for i in range(30) for j in range(12) if rng.random() < 0.3]
    tab = spark.createDataFrame(cells, "feature string, sample string, value double").cache()
    groups = spark.createDataFrame([(f"s{j}", "xyzw"[j % 4]) for j in range(12)], "sample string, grp string")
    got = lambda: {(r["s1"], r["s2"]): [r[c] for c in ("obs", "null_mean", "null_std", "p")] for r in nulls.rcq(tab, kind, 1, 6, groups, seed=3, arrays=True).collect()}
    want = got()
    monkeypatch.setattr(drawn, "MOST_POOLED", most)
    monkeypatch.setattr(drawn, "STORED", stored)
    found = got()
    assert set(found) == set(want) and len(want) == 66
    for k, v in want.items():
        np.testing.assert_allclose(found[k], v, atol=1e-9)
