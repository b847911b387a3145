"""All pairs by blocks against the join, without a shuffle of pairs."""

import numpy as np
import pytest

from biotally.operators import beta, pairwise

KINDS = {"bray": lambda t, **k: beta.bray(t, **k), "jaccard": lambda t, **k: beta.jaccard(t, **k), **{f"naive{q}": lambda t, q=q, **k: beta.naive_beta(t, q, **k) for q in (0, 1, 1.5)}}


@pytest.fixture(scope="module")
def tab(spark):
    rng = np.random.default_rng(3)
    rows = [(f"f{k}", f"s{j}", float(rng.integers(1, 9))) for k in range(40) for j in range(23) if rng.random() < 0.3]
    rows += [("lone", "apart", 2.0), (None, "s1", 3.0), ("f1", None, 1.0), ("f2", "s3", 0.0), ("f3", "é", 1.0), ("f3", "z", 2.0)]
    return spark.createDataFrame(rows, "feature string, sample string, value double").cache()


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize(("block", "pairs", "out"), [(1024, 1 << 21, 1 << 17), (5, 3, 7)])
def test_blocks_are_the_join(monkeypatch, tab, kind, block, pairs, out):
    for name, value in (("BLOCK", block), ("PAIRS", pairs), ("OUT", out)):
        monkeypatch.setattr(pairwise, name, value)
    got = {tuple(r)[:2]: r[2] for r in KINDS[kind](tab).collect()}
    want = {tuple(r)[:2]: r[2] for r in KINDS[kind](tab, spine=beta.pair_spine(tab)).collect()}
    assert got.keys() == want.keys() and len(got) > 250
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_are_not_shuffled(tab):
    plan = beta.bray(tab)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_cases(monkeypatch, tab):
    assert beta.bray(tab.limit(0)).collect() == []
    monkeypatch.setattr(pairwise, "MOST_CELLS", 2)
    assert pairwise.all_pairs(tab, pairwise.bray()) is None and beta.bray(tab).count() > 250


def test_blocks_are_packed_behind_the_shuffle(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pairwise, "settled", lambda df: seen.append(df) or df.persist())
    tab = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "feature string, sample string, value double")
    assert pairwise.all_pairs(tab, pairwise.jaccard()).count() == 1
    plan = seen[0]._jdf.queryExecution().analyzed().toString()
    assert plan.startswith("FlatMapGroupsInArrow") and "RepartitionByExpression" in plan


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_rows_of_a_cell_add_up_behind_the_shuffle(spark, monkeypatch, tab, kind):
    """One shuffle of the table's rows, that to blocks, and no other to add them up."""
    seen = []
    monkeypatch.setattr(pairwise, "settled", lambda df: seen.append(df) or df.persist())
    monkeypatch.setattr(pairwise, "BLOCK", 5)
    rows = tab.where("value > 0 and feature is not null").selectExpr("feature", "sample", "explode(array(value - 0.5, 0.25, 0.25)) value")
    more = rows.union(spark.createDataFrame([("f1", "s1", 2.0), ("f1", "s1", -2.0), ("x", "none", 0.0)], rows.schema))
    got = {tuple(r)[:2]: r[2] for r in KINDS[kind](more, repeated=True).collect()}
    want = {tuple(r)[:2]: r[2] for r in KINDS[kind](tab.where("feature is not null")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    monkeypatch.setattr(pairwise, "MOST_CELLS", 2)  # by the join
    joined = {tuple(r)[:2]: r[2] for r in KINDS[kind](more.where("sample <> 'none'"), repeated=True).collect()}
    assert joined.keys() == want.keys() and all(abs(joined[k] - want[k]) < 1e-9 for k in want)
