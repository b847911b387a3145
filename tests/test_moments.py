"""Null models by moments: the same values as with a row for everything, by
blocks of any size; moments that merge to those of all."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import biotally
from biotally.operators import alpha, moments, nulls

KINDS = {"nri": (moments.mean_pairwise, True), "nti": (moments.mean_nearest, True), "beta_nri": (moments.between_pairwise, False), "beta_nti": (moments.between_nearest, False)}


@pytest.fixture(scope="module")
def community(spark):
    rng = np.random.default_rng(4)
    cells = [(f"f{i}", f"s{j}", float(rng.integers(1, 50))) for i in range(13) for j in range(7) if rng.random() < 0.5]
    cells += [("only", "alone", 3.0), ("f1", "two", 1.0), ("é", "two", 2.0)]
    apart = {(f"f{i}", f"f{j}"): float(abs(i - j) % 5 + (i + j) % 3 + 0.25) for i in range(13) for j in range(i)}
    apart |= {("é", "f1"): 2.0, ("elsewhere", "f2"): 1.0}  # "only" has no distance at all
    d = [(a, b, v) for (x, y), v in apart.items() for a, b in ((x, y), (y, x))]
    return spark.createDataFrame(cells, "feature string, sample string, value double").cache(), spark.createDataFrame(d, "f1 string, f2 string, d double").cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [x is None for x in a] == [x is None for x in b], (a, b)
        assert all(x == y if isinstance(x, str) else x is None or abs(x - y) < 1e-9 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("randomization", ["features", "abundances"])
def test_blocks_of_any_size(community, kind, randomization):
    tab, d = community
    q = 0.5 if randomization == "features" else 1
    want = rows(getattr(nulls, kind)(tab, d, q, 5, randomization, seed=3))
    same(rows(getattr(nulls, kind)(tab, d, q, 5, randomization, seed=3, arrays=True)), want)
    sums, own = KINDS[kind]
    # Several blocks of samples, parts of the matrix, chunks of two iterations.
    got = moments.against_null(alpha.powers(tab, q), d, sums, 5, 3, randomization, own=own, cells=64, block=4, numbers=2 * (4 if own else 16))
    same(rows(got), want)


def test_conspecifics(community):
    tab, d = community
    want = rows(nulls.beta_nti(tab, d, 1, 4, include_conspecifics=True, seed=1))
    same(rows(nulls.beta_nti(tab, d, 1, 4, include_conspecifics=True, seed=1, arrays=True)), want)
    assert want != rows(nulls.beta_nti(tab, d, 1, 4, seed=1))


def test_cases(spark, community):
    tab, d = community
    assert rows(nulls.nri(tab.limit(0), d, 1, 3, arrays=True)) == []
    assert [r[1:] for r in rows(nulls.nti(tab, d.limit(0), 1, 3, arrays=True))] == [(None,) * 5] * 9
    nameless = tab.unionByName(spark.createDataFrame([(None, None, 1.0)], tab.schema))
    assert rows(nulls.nri(nameless, d, 1, 3, arrays=True)) == rows(nulls.nri(tab, d, 1, 3, arrays=True))
    wider = tab.withColumn("w", F.lit(1)).withColumn("place", F.lit("x"))
    same(rows(nulls.nri(wider, d, 1, 3, arrays=True)), rows(nulls.nri(tab, d, 1, 3, arrays=True)))
    with pytest.raises(ValueError, match="randomization"):
        nulls.nri(tab, d, 1, 3, "samples", arrays=True)
    with pytest.raises(ValueError, match="iteration"):
        nulls.nri(tab, d, 1, 0, arrays=True)


def test_too_many_features(community, monkeypatch):
    monkeypatch.setattr(moments, "MOST_FEATURES", 3)
    with pytest.raises(ValueError, match="arrays=False"):
        nulls.nri(*community, 1, 3, arrays=True)


def test_moments_merge():
    rng = np.random.default_rng(0)
    obs, null = rng.normal(size=(1, 6)), rng.normal(size=(40, 6)) + 1e6 * (np.arange(6) == 2)
    null[:, 4], null[:, 5] = 0.3, obs[0, 5]
    null[7, 1] = np.nan
    want = moments.summed(np.vstack([obs, null]))
    got = None
    for part in np.split(null, [1, 9, 30]):
        m = moments.summed(np.vstack([obs, part]))
        got = m if got is None else moments.merged(got, m)
    for k in moments.MOMENTS:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-12)
    assert want["known"][1] == 39 and want["equal"][5] == 40 and got["square"][4] < 1e-20


def test_executors_without_the_package(tmp_path):
    """The repository is on the driver's path alone."""
    root = os.path.dirname(os.path.dirname(biotally.__file__))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from biotally.operators import nulls
tab = spark.createDataFrame([(f"f{{i}}", f"s{{j}}", float(i + j + 1)) for i in range(6) for j in range(3) if (i + j) % 4], "feature string, sample string, value double")
d = spark.createDataFrame([(f"f{{i}}", f"f{{j}}", float(abs(i - j))) for i in range(6) for j in range(6) if i != j], "f1 string, f2 string, d double")
print("rows", nulls.beta_nri(tab, d, 1, 3, arrays=True).count() + nulls.rcq(tab, "naive", 1, 3, arrays=True).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert said.stdout.split()[-2:] == ["rows", "6"], said.stderr[-2000:]
