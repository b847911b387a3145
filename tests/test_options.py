"""Options of single functions."""

import pytest

from biotally.model import Community
from biotally.operators import relational, statistics, trees
from biotally.sources import newick

TAB = "feature string, sample string, value double"


def test_rename_leaves(spark):
    tree = spark.createDataFrame([("r", None, 0.0), ("a", "r", 1.0), ("b", "r", 1.0)], "node string, parent string, branchL double")
    names = lambda *rows: spark.createDataFrame(list(rows), "old string, new string")
    assert {r["node"] for r in trees.rename_leaves(tree, names(("a", "x"), ("gone", "y"))).collect()} == {"r", "x", "b"}
    with pytest.raises(ValueError, match="gone"):
        trees.rename_leaves(tree, names(("a", "x"), ("gone", "y")), allow_partial=False)
    with pytest.raises(ValueError, match="'r'"):
        trees.rename_leaves(tree, names(("r", "x")), allow_partial=False)
    assert {r["node"] for r in trees.rename_leaves(tree, names(("a", "x")), allow_partial=False).collect()} == {"r", "x", "b"}


def test_subset_taxa(spark):
    tab = spark.createDataFrame([("a", "s", 1.0)], TAB)
    tax = spark.createDataFrame([("a", "Bac")], "feature string, Domain string")
    assert relational.subset_taxa(tab, tax, "none").count() == 0
    with pytest.raises(ValueError):
        relational.subset_taxa(tab, tax, "none", allow_empty=False)
    assert relational.subset_taxa(tab, tax, "bac", allow_empty=False).count() == 1


def test_redraws(spark):
    rows = [(f"s{i}", f"s{j}", float(i * j)) for i in range(6) for j in range(i + 1, 6)]
    pairs = spark.createDataFrame(rows, "s1 string, s2 string, value double")
    meta = spark.createDataFrame([(f"s{i}", "ab"[i % 2]) for i in range(6)], "sample string, grp string")
    each = statistics.bootstrap(pairs, meta, "grp", 30, return_boot=True).toPandas()
    whole = {(r["factor"], r["part"]): r for r in statistics.bootstrap(pairs, meta, "grp", 30).collect()}
    for (factor, part), own in each.groupby(["factor", "part"]):
        assert own["boot"].is_unique and whole[factor, part]["mean"] == pytest.approx(own["mean"].mean())


def test_community_thins_on_counts(spark):
    tab = spark.createDataFrame([("a", "s", 30.0), ("b", "s", 50.0), ("a", "t", 40.0)], TAB)
    got = Community(tab=tab).rarefy(20, 1, method="counts").tab.groupBy("sample").sum("value").collect()
    assert {tuple(r) for r in got} == {("s", 20.0), ("t", 20.0)}


def test_pruned_communities(spark):
    tree = spark.createDataFrame([("r", None, 0.0), ("i", "r", 1.0), ("a", "i", 1.0), ("b", "i", 2.0), ("c", "r", 7.0)], "node string, parent string, branchL double")
    c = Community(tab=spark.createDataFrame([("a", "s", 1.0), ("c", "s", 1.0)], TAB), tree=tree, node_leaf=trees.closure(tree))
    assert {(r["node"], r["branchL"]) for r in c.prune_tree().tree.collect()} == {("r", 0.0), ("a", 2.0), ("c", 7.0)}
    turned = {r["node"]: r["dist_to_root"] for r in c.prune_tree(["a", "b", "c"], reroot=True).tree.collect()}
    assert turned["c"] == turned["b"] == 5.0 and turned["in_midroot"] == 0.0
    with pytest.raises(ValueError):
        c.prune_tree(["none"])


def test_trees_in_a_column(spark):
    rows = [(1, "((A:1,B:2)i:1,C:3)r;", "x"), (2, None, "x"), (3, " ", "y"), (4, "(A,B);", "y"), (4, "A;", None)]
    df = spark.createDataFrame(rows, "id int, newick string, node_id string")
    got = [tuple(r) for r in newick.parse_column(df).collect()]
    assert sorted(r[2] for r in got if r[0] == 1) == ["A", "B", "C", "i", "r"]
    assert {(r[2], r[3], r[4], r[5]) for r in got if r[0] == 1} >= {("B", "i", 2.0, 3.0), ("r", None, 0.0, 0.0)}
    assert sorted((r[0], r[1], r[2]) for r in got if r[0] == 4 and r[1]) == [(4, "y", "A"), (4, "y", "B"), (4, "y", "in1")]
    assert (4, None, "A", None, 0.0, 0.0) in got
    assert {r[0] for r in got} == {1, 4}
    bad = df.limit(0).unionByName(spark.createDataFrame([(5, "((A,B);", "z")], df.schema))
    assert newick.parse_column(bad, strict=False).collect() == []
    with pytest.raises(Exception, match="brackets"):
        newick.parse_column(bad).collect()
    assert newick.parse_column(df.limit(0)).collect() == []


def test_readers_of_communities(spark, tmp_path):
    def file(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    tab = spark.createDataFrame([("A", "s", 3.0), ("B", "s", 1.0), ("C", "s", 2.0)], TAB)
    c = Community(tab=tab)
    held = lambda x: {r["feature"] for r in x.tab.collect()}
    q = c.add_qiime(spark, file("q.tsv", "Feature ID\tTaxon", "A\td__Bac; p__Pro", "B\td__Arc"))
    assert held(q) == {"A", "B"} and {r["feature"]: r["Domain"] for r in q.tax.collect()} == {"A": "Bac", "B": "Arc"}
    g = c.add_gtdb(spark, file("g.tsv", "user_genome\tclassification", "A\td__Bac;p__Pro"), file("h.tsv", "user_genome\tclassification", "C\td__Arc;p__"))
    assert held(g) == {"A", "C"}
    x = c.add_sintax(spark, file("s.txt", "A\td:Bac(1.00),p:Pro(0.9)\t+\td:Bac,p:Pro"))
    assert held(x) == {"A"}
    f = c.add_fasta(spark, file("f.fa", ">A;size=1", "ACGT", ">B;size=2", "GG", "CC"), ";")
    assert {r["feature"]: r["seq"] for r in f.seq.collect()} == {"A": "ACGT", "B": "GGCC"}
    p = file("c.tsv", "Genome\ts1 Relative Abundance (%)\ts2 Relative Abundance (%)", "unmapped\t40\t10", "G1\t60\t50", "G2\t0\t40")
    m = Community().add_coverm(spark, p)
    assert {(r["sample"], r["unmapped_reads_perc"]) for r in m.meta.collect()} == {("s1", 40.0), ("s2", 10.0)}
    assert {tuple(r) for r in m.tab.select("feature", "sample", "value").collect()} == {("G1", "s1", 60.0), ("G1", "s2", 50.0), ("G2", "s2", 40.0)}
    meta = spark.createDataFrame([("s1", "x"), ("s3", "y")], "sample string, grp string")
    m = Community(meta=meta).add_coverm(spark, p)
    assert [tuple(r) for r in m.meta.select("sample", "grp", "unmapped_reads_perc").collect()] == [("s1", "x", 40.0)]
    e = Community().add_ebd(spark, file("e.tsv", "sample\tRoot; d__Bac; p__Pro\tRoot; d__Arc", "s1\t2\t0", "s2\t1\t4"))
    assert {tuple(r) for r in e.tab.select("feature", "sample", "value").collect()} == {("OTU1", "s1", 2.0), ("OTU1", "s2", 1.0), ("OTU2", "s2", 4.0)}
    assert {r["feature"]: r["Domain"] for r in e.tax.collect()} == {"OTU1": "d__Bac", "OTU2": "d__Arc"}
