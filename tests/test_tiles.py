"""Sums over shared keys by tiles against the join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import beta, tiles, trees

TAB = "feature string, sample string, value double"


@pytest.fixture(scope="module")
def tab(spark):
    """A feature that all samples have, some that many have, many that few have."""
    rng = np.random.default_rng(3)
    rows = [("all", f"s{j}", float(rng.integers(1, 9))) for j in range(30)]
    rows += [(f"m{k}", f"s{j}", float(rng.integers(1, 9))) for k in range(12) for j in range(30) if rng.random() < 0.4]
    rows += [(f"f{k}", f"s{rng.integers(30)}", float(rng.integers(1, 9))) for k in range(80)]
    rows += [("lone", "apart", 2.0)]
    return spark.createDataFrame(list({r[:2]: r for r in rows}.values()), TAB)


def gathered(df):
    return {(r["s1"], r["s2"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize(("block", "rows", "pairs"), [(7, 20, 1 << 21), (5, 1 << 20, 3), (1, 1, 1)])
def test_tiles_are_the_join(monkeypatch, tab, block, rows, pairs):
    tree = tab.sparkSession.createDataFrame([("root", None, 0.1)] + [(c, "root", 0.4) for c in "amfl"], "node string, parent string, branchL double")
    tips = tab.select("feature").distinct().select(F.col("feature").alias("node"), F.substring("feature", 1, 1).alias("parent"), F.lit(0.7).alias("branchL"))
    tree = tree.unionByName(tips)
    leaves = trees.closure(tree)
    made = lambda: [gathered(x) for x in (beta.naive_beta(tab, 1, tiled=True), *(beta.phyl_beta(tab, tree, leaves, q) for q in (0, 1, 2)))] + [gathered(beta.bray(tab, tiled=True))]
    monkeypatch.setattr(tiles, "BLOCK", 1000)
    want = made()
    for name, value in (("BLOCK", block), ("ROWS", rows), ("PAIRS", pairs)):
        monkeypatch.setattr(tiles, name, value)
    got = made()
    for g, w in zip(got, want, strict=True):
        assert g.keys() == w.keys()
        assert all(g[k] == pytest.approx(w[k], abs=1e-9) for k in w)


def test_both_paths_are_taken(monkeypatch, tab):
    monkeypatch.setattr(tiles, "BLOCK", 8)
    taken = []
    real = tiles.tiled_sums
    monkeypatch.setattr(tiles, "tiled_sums", lambda rows, *a: taken.append({r[0] for r in rows.select("feature").distinct().collect()}) or real(rows, *a))
    p = tab.select("feature", "sample", F.col("value").alias("p"))
    joined = []
    tiles.split_sums(p, "feature", lambda own: joined.append({r[0] for r in own.select("feature").distinct().collect()}) or beta.shared_sums(own, "feature", F.sum(F.least("p1", "p2"))), lambda a, b: np.minimum(a[0], b[0])).collect()
    assert "all" in taken[0] and "lone" in joined[0] and not taken[0] & joined[0]


def test_empty(tab):
    assert beta.naive_beta(tab.limit(0), 1, tiled=True).collect() == []
