"""Tables that ask for more tasks than the session has: a task's rows do not grow."""

import math

import pytest

from biotally.operators import alpha, relational, taxonomy
from biotally.plans import fixtures as fx
from biotally.sources import text

SF = "/root/testdata/sf0.001"
TAX = "feature string, Domain string, Phylum string, Genus string"


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(relational, "ROWS", 300)


def largest(df):
    return max(df.rdd.glom().map(len).collect())


def test_tasks_follow_rows(spark, many):
    assert fx.tasks(spark, SF) == 20 and relational.tasks_for(spark.range(5)) == 4
    assert largest(fx.tab_wide(spark, SF)) < 900  # 6,000 rows on 4 tasks before


@pytest.mark.parametrize("build", [
    lambda s, n: relational.subset_taxa(fx.tab_wide(s, SF), fx.tax(s, SF), "brand", "phylum", regex=True, exclude=True, tasks=n),
    lambda s, n: taxonomy.group_by_taxa(fx.tab_wide(s, SF), fx.tax(s, SF), ["Phylum", "Genus"], n),
    lambda s, n: relational.merge_samples(fx.tab_wide(s, SF), fx.supplier_meta(s, SF), ["region", "nation"], method="mean", tasks=n),
    lambda s, n: relational.summarize_taxa(fx.tab_wide(s, SF), fx.tax(s, SF), n),
    lambda s, n: alpha.mean_height(fx.tab_wide(s, SF), fx.tree_large(s, SF), fx.leaves_large(s, SF), tasks=n),
])
def test_results_do_not_depend_on_tasks(spark, many, build):
    def rows(n):
        return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in build(spark, n).collect()], key=repr)

    assert rows(fx.tasks(spark, SF)) == rows(None)
    plan = build(spark, 23)._jdf.queryExecution().toString()
    assert ", 23), REPARTITION_BY_NUM" in plan


def test_mean_height_makes_no_row_a_node_and_sample(spark):
    tab = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0), ("z", "y", 2.0), ("z", "w", 1.0)], "feature string, sample string, value double")
    tree = spark.createDataFrame([("r", None, 0.5), ("a", "r", 1.0), ("b", "r", 2.0)], "node string, parent string, branchL double")
    leaves = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "a"), ("b", "b")], "node string, leaf string")
    out = alpha.mean_height(tab, tree, leaves)
    assert {r["sample"]: r["t"] for r in out.collect()} == pytest.approx({"x": 2.25, "y": 0.75})
    assert "keys=[node" not in out._jdf.queryExecution().toString()


def test_single_leaves_are_added_up_without_a_row_a_node(spark):
    tab = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0)], "feature string, sample string, value double")
    tree = spark.createDataFrame([("r", None, 0.5), ("a", "r", 1.0), ("b", "r", 2.0)], "node string, parent string, branchL double")
    leaves = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "a"), ("b", "b")], "node string, leaf string")
    for q, want in ((2, (0.5 + 0.0625 + 2 * 0.5625) / 2.25), (0, 3.5 / 2.25), (1, (0.25 * math.log(0.25) + 2 * 0.75 * math.log(0.75)) / 2.25)):
        out = alpha.phyl_alpha(tab, tree, leaves, q, "H")
        assert [r["d"] for r in out.collect()] == pytest.approx([want])
    # The table is dealt by features once: no window over samples.
    assert "Window" not in out._jdf.queryExecution().sparkPlan().toString()


def test_coverm_is_one_aggregation(spark):
    long = spark.createDataFrame([("a", "x", "ra", 4.0), ("a", "x", "bases", 8.0), ("a", "x", "length", 10.0), ("b", "x", "ra", 5.0), ("b", "x", "fraction", 0.1), ("unmapped", "x", "ra", 91.0), ("unmapped", "x", "fraction", 0.0)], "feature string, sample string, measure string, value double")
    tab, unmapped = text.coverm_table(long, 0.5)
    assert [tuple(r) for r in tab.collect()] == [("a", "x", 4.0)] and [tuple(r) for r in unmapped.collect()] == [("x", 91.0)]
    plan = tab._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Aggregate(") == 2 and "pivotfirst" not in plan


def test_phyl_alpha_spreads_cells_behind_their_shuffle(spark):
    """Cells are dealt by samples to as many tasks as asked for; sums by node need no other shuffle."""
    tab = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("z", "x", 4.0), ("z", "w", 1.0), ("b", None, 1.0)], "feature string, sample string, value double")
    tree = spark.createDataFrame([("r", None, 0.5), ("p", "r", 0.5), ("a", "p", 1.0), ("b", "p", 2.0), ("bb", "b", 1.0)], "node string, parent string, branchL double")
    leaves = spark.createDataFrame([("r", "a"), ("r", "b"), ("p", "a"), ("p", "b"), ("a", "a"), ("b", "b"), ("bb", "b")], "node string, leaf string")
    t = 0.5 * 0.5 * 2 + 0.125 + 3 * 0.375  # z has no place in the tree and counts in the total
    for q, want in ((2, (0.25 * 2 * 0.5 + 0.125**2 + 3 * 0.375**2) / t), (0, 5 / t)):
        out = alpha.phyl_alpha(tab, tree, leaves, q, "H", tasks=23)
        assert [(r["sample"], pytest.approx(r["d"])) for r in out.collect()] == [("x", want)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(sample" in plan and ", 23), REPARTITION_BY_NUM" in plan and "hashpartitioning(sample#" in plan
    assert not [x for x in plan.split("\n") if "hashpartitioning(sample" in x and "ENSURE_REQUIREMENTS" in x]
