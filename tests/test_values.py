"""Known values, invariants and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from biotally.functions.hill import dissimilarity
from biotally.operators import alpha, beta, combine, nulls, ordination, relational, sequences, simulate, statistics, trees
from biotally.sources import newick, text

TOY = [("OTU1", "S1", 10.0), ("OTU1", "S2", 5.0), ("OTU1", "S3", 1.0), ("OTU2", "S2", 5.0), ("OTU2", "S3", 1.0), ("OTU3", "S3", 1.0), ("OTU4", "S3", 7.0)]
TAB = "feature string, sample string, value double"


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, TAB).cache()


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def pair(df, a, b):
    return by(df, "s1", "s2")[a, b]["value"]


def test_naive_alpha(toy):
    d = {q: {k: r["d"] for k, r in by(alpha.naive_alpha(toy, q), "sample").items()} for q in (0, 1, 2)}
    assert d[0] == pytest.approx({"S1": 1, "S2": 2, "S3": 4})
    assert d[1]["S2"] == pytest.approx(2) and 2.56 < d[1]["S3"] < 2.57
    assert d[2]["S2"] == pytest.approx(2) and 1.92 < d[2]["S3"] < 1.93
    assert all(d[0][s] >= d[1][s] - 1e-9 >= d[2][s] - 2e-9 for s in d[0])


def test_naive_beta(toy):
    assert pair(beta.naive_beta(toy, 0), "S1", "S3") == pytest.approx(0.75)
    assert 0.310 < pair(beta.naive_beta(toy, 1), "S1", "S2") < 0.315
    assert 0.767 < pair(beta.naive_beta(toy, 2), "S1", "S3") < 0.768
    assert pair(beta.bray(toy), "S1", "S3") == pytest.approx(0.9)
    assert pair(beta.jaccard(toy), "S1", "S3") == pytest.approx(0.75)


@pytest.mark.parametrize("q", [0, 0.5, 1, 2])
@pytest.mark.parametrize("view", ["local", "regional"])
def test_same_and_disjoint_samples(spark, q, view):
    rows = [("a", "x", 2.0), ("b", "x", 2.0), ("a", "y", 5.0), ("b", "y", 5.0), ("c", "z", 1.0), ("d", "z", 1.0)]
    tab = spark.createDataFrame(rows, TAB)
    got = beta.naive_beta(tab, q, viewpoint=view)
    assert pair(got, "x", "y") == pytest.approx(0, abs=1e-9) and pair(got, "x", "z") == pytest.approx(1)


def star(spark, names):
    root = newick.parse("(" + ",".join(f"{n}:1" for n in names) + ");")
    return newick.to_tables(spark, root)


@pytest.mark.parametrize("q", [0, 1, 2])
def test_star_tree_is_naive(spark, toy, q):
    nodes, leaves = star(spark, ["OTU1", "OTU2", "OTU3", "OTU4"])
    a, b = by(alpha.phyl_alpha(toy, nodes, leaves, q), "sample"), by(alpha.naive_alpha(toy, q), "sample")
    assert all(a[s]["d"] == pytest.approx(b[s]["d"]) for s in b)
    a, b = by(beta.phyl_beta(toy, nodes, leaves, q), "s1", "s2"), by(beta.naive_beta(toy, q), "s1", "s2")
    assert all(a[s]["value"] == pytest.approx(b[s]["value"]) for s in b)


def equidistant(spark):
    names = ["OTU1", "OTU2", "OTU3", "OTU4"]
    return spark.createDataFrame([(a, b, 1.0) for a in names for b in names if a != b], "f1 string, f2 string, d double")


def test_rao_of_equidistant_features(spark, toy):
    got = by(alpha.rao(toy, equidistant(spark)), "sample")
    assert got["S1"]["q_rao"] == 0 and got["S2"]["q_rao"] == pytest.approx(0.5)
    assert by(alpha.mpd(toy, equidistant(spark), 1), "sample")["S3"]["mpd"] == pytest.approx(1)
    assert by(alpha.mpd(toy, equidistant(spark), 1), "sample")["S1"]["mpd"] is None
    assert by(alpha.mntd(toy, equidistant(spark), 1), "sample")["S1"]["mntd"] is None


def test_multi_beta_bounds(toy, spark):
    groups = spark.createDataFrame([("S1", "g"), ("S2", "g"), ("S3", "h")], "sample string, grp string")
    got = by(beta.naive_multi_beta(toy, groups, 1), "grp")
    assert 1 <= got["g"]["beta"] <= 2 and got["h"]["n"] is None and got["h"]["beta"] is None
    pct = beta.dissimilarity_by_feature(toy, None, 1).agg(F.sum("pct")).first()[0]
    assert pct == pytest.approx(100)


def test_beta_that_is_not_positive_stays(spark):
    r = spark.range(1).select(dissimilarity(F.lit(0.0), 2).alias("a"), dissimilarity(F.lit(1.0), 1, 1.0).alias("b")).first()
    assert r["a"] == 0 and r["b"] is None


def test_square(toy):
    rows = {r["s1"]: r.asDict() for r in beta.to_square(beta.bray(toy)).collect()}
    assert rows["S1"]["S1"] == 0 and rows["S1"]["S3"] == rows["S3"]["S1"] == pytest.approx(0.9)


# -- trees


def test_newick():
    t = newick.parse("((A:1,B:2)0.9:1,(C:1,'D d':1)x:2,E:1)root;")
    assert [n.name for n in t.leaves()] == ["A", "B", "C", "D d", "E"]
    assert t.children[0].name == "in1" and t.children[0].support == 0.9 and t.children[1].name == "x"
    assert newick.write(newick.parse(newick.write(t, 2)), 2) == newick.write(t, 2)
    assert newick.parse("A;").name == "A"
    with pytest.raises(ValueError):
        newick.parse("((A,B);")
    deep = "(" * 5000 + "A:1,B:1" + "):1,C:1" * 4999 + ");"
    assert len(newick.parse(deep).leaves()) == 5001


def test_prune_and_reroot(spark):
    t = newick.prune(newick.parse("((A:1,B:2)i:1,(C:1,D:1)j:2,E:9)r;"), {"A", "C", "D", "E"})
    lengths = {n.name: n.length for n in t.walk()}
    assert lengths["A"] == 2 and {n.name for n in t.leaves()} == {"A", "C", "D", "E"}
    m = newick.reroot_midpoint(t)
    nodes, leaves = newick.rows(m)
    heights = {r[0]: r[3] for r in nodes}
    tips = {n.name for n in m.leaves()}
    assert tips == {"A", "C", "D", "E"} and heights["E"] == pytest.approx(6.0) and max(heights[x] for x in tips) == pytest.approx(6.0)
    df, closure = newick.to_tables(spark, m)
    dist = {(r["f1"], r["f2"]): r["d"] for r in trees.tree_distance(df, closure).collect()}
    assert dist["C", "E"] == pytest.approx(12) and dist["A", "E"] == pytest.approx(11) and dist["C", "D"] == pytest.approx(2)


def test_closure_by_recursion(spark):
    df, closure = newick.to_tables(spark, newick.parse("((A:1,B:2)i:1,C:3)r;"))
    assert {tuple(r) for r in trees.closure(df).collect()} == {tuple(r) for r in closure.collect()}
    with pytest.raises(ValueError):
        trees.rename_leaves(df, spark.createDataFrame([("A", "B")], "old string, new string"))


# -- readers


def put(path, name, body):
    (path / name).write_text(body)
    return str(path / name)


def test_read_tab(spark, tmp_path):
    p = put(tmp_path, "a.tsv", "# Constructed from biom file\n#OTU ID\ts1\ts2\tGenus\nO1\t3\t0\tg__X\nO2\t1.5\t2\t\n")
    tab, tax = text.read_tab(spark, p)
    assert {tuple(r) for r in tab.collect()} == {("O1", "s1", 3.0), ("O2", "s1", 1.5), ("O2", "s2", 2.0)}
    assert {r["feature"]: r["Genus"] for r in tax.collect()} == {"O1": "g__X", "O2": None}
    bad = put(tmp_path, "b.csv", "id,s1\nO1,x\n")
    with pytest.raises(Exception, match="not a number"):
        text.read_tab(spark, bad)[0].collect()
    semi = put(tmp_path, "c.csv", "id;s1\nO1;4\n")
    assert text.read_tab(spark, semi)[0].first()["value"] == 4


def test_read_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">id1;size=3\nACG\nTT\n\n>id2\nGG\n")
    assert {tuple(r) for r in text.read_fasta(spark, p, ";").collect()} == {("id1", "ACGTT"), ("id2", "GG")}


def test_read_taxonomies(spark, tmp_path):
    q = put(tmp_path, "q.tsv", "Feature ID\tTaxon\tConfidence\na\td__Bac; p__Fir; c__\t1\nb\tBac;Fir\t1\nc\tUnassigned\t1\n")
    rows = by(text.read_qiime(spark, q), "feature")
    assert (rows["a"]["Domain"], rows["a"]["Phylum"], rows["a"]["Class"]) == ("Bac", "Fir", "")
    assert (rows["b"]["Domain"], rows["b"]["Phylum"], rows["c"]["Domain"]) == ("Bac", "Fir", "")
    s = put(tmp_path, "s.txt", "a\td:Bac(1)\t+\td:Bac,p:Fir\nb\td:X\n>c\nd:Y(1)\t+\td:Y\n")
    rows = by(text.read_sintax(spark, s), "feature")
    assert rows["a"]["Phylum"] == "p__Fir" and rows["b"]["Domain"] is None and rows["c"]["Domain"] == "d__Y"
    g = put(tmp_path, "g.tsv", "user_genome\tclassification\nx\td__A;p__B;s__\ny\t\n")
    rows = by(text.read_gtdb(spark, [g]), "feature")
    assert (rows["x"]["Phylum"], rows["x"]["Species"], rows["x"]["Class"], rows["y"]["Domain"]) == ("B", "", None, None)
    t = put(tmp_path, "t.csv", "id,Phylum\na,Fir\nb,nan\nc,p__X\n")
    assert {k: r["Phylum"] for k, r in by(text.read_tax(spark, t), "feature").items()} == {"a": "p__Fir", "b": None, "c": "p__X"}


def test_read_coverm_and_ebd(spark, tmp_path):
    p = put(tmp_path, "c.tsv", "Genome\tx/s1 Relative Abundance (%)\tx/s1 Covered Bases\tx/s1 Length\nunmapped\t10\t\t\ng1\t60\t90\t100\ng2\t30\t10\t100\n")
    tab, unmapped = text.read_coverm(spark, p, first_sep="/", threshold=0.5)
    assert [tuple(r) for r in tab.collect()] == [("g1", "s1", 60.0)] and [tuple(r) for r in unmapped.collect()] == [("s1", 10.0)]
    none = put(tmp_path, "n.tsv", "Genome\ts1 Relative Abundance (%)\ng1\t60\n")
    with pytest.raises(Exception, match="neither"):
        text.read_coverm(spark, none, threshold=0.5)[0].collect()
    e = put(tmp_path, "e.tsv", "sample\tRoot; d__A\tRoot; d__A; p__B.1\ns1\t0.5\t2\ns2\t0\t1\n")
    tab, tax = text.read_ebd(spark, e)
    assert {tuple(r) for r in tab.collect()} == {("OTU1", "s1", 0.5), ("OTU2", "s1", 2.0), ("OTU2", "s2", 1.0)}
    assert by(tax, "feature")["OTU2"]["Phylum"] == "p__B.1" and by(tax, "feature")["OTU1"]["Phylum"] is None


def test_save_and_read_again(spark, toy, tmp_path):
    text.save(str(tmp_path / "x"), tab=toy, newick="(A:1,B:1);")
    tab, _ = text.read_tab(spark, f"{tmp_path}/x_tab.csv/*.csv")
    assert {tuple(r) for r in tab.collect()} == set(TOY)


# -- thinning, nulls, statistics


def test_rarefy_keeps_depth(toy):
    for replacement in (False, True):
        got = relational.rarefy(toy, "min", 3, replacement).groupBy("sample").agg(F.sum("value").alias("v")).collect()
        assert len(got) == 3 and all(r["v"] == 10 for r in got)
    a, b = relational.rarefy(toy, 5, 3), relational.rarefy(toy.repartition(3), 5, 3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_null_models_repeat(spark, toy):
    a, b = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in nulls.rcq(toy, "naive", 1, 5, seed=1).orderBy("s1", "s2").collect()] for _ in range(2))
    assert a == b and all(0 <= r[5] <= 1 for r in a)
    t = nulls.random_tables(toy, 4, 1).groupBy("it", "sample").agg(F.sum("value").alias("reads"), F.count(F.lit(1)).alias("richness")).collect()
    assert all((r["reads"], r["richness"]) == {"S1": (10, 1), "S2": (10, 2), "S3": (10, 4)}[r["sample"]] for r in t)
    with pytest.raises(Exception, match="whole"):
        nulls.random_tables(toy.withColumn("value", F.col("value") + 0.5), 1, 1).collect()
    groups = spark.createDataFrame([("S1", None), ("S2", "a"), ("S3", "a")], "sample string, grp string")
    with pytest.raises(Exception, match="no group"):
        nulls.random_tables(toy, 1, 1, groups).collect()


def test_mantel_of_itself(toy):
    r = statistics.mantel(beta.bray(toy), beta.bray(toy), "pearson", 9).first()
    assert r["stat"] == pytest.approx(0, abs=1e-9) and 0 < r["p"] <= 1


def test_pcoa_and_permanova_agree_with_sums(spark):
    d = spark.createDataFrame([("s1", "s2", 0.3), ("s1", "s3", 0.4), ("s2", "s3", 0.5)], "s1 string, s2 string, value double")
    rows = ordination.pcoa(d).collect()
    assert all(r["eigenvalue"] > 0 for r in rows)
    at = {}
    for r in rows:
        at.setdefault(r["sample"], {})[r["axis"]] = r["score"]
    assert math.dist(at["s1"].values(), at["s2"].values()) == pytest.approx(0.3)
    import itertools
    import random

    rng = random.Random(2)
    pairs = spark.createDataFrame([(a, b, rng.random()) for a, b in itertools.combinations([f"n{k}" for k in range(9)], 2)], "s1 string, s2 string, value double")
    meta = spark.createDataFrame([(f"n{k}", "abc"[k % 3], k % 2) for k in range(9)], "sample string, grp string, other int")
    one = by(statistics.permanova_oneway(pairs, meta.select("sample", "grp")), "term")
    two = by(ordination.permanova(pairs, meta, "grp", 19), "term")
    assert two["grp"]["f"] == pytest.approx(one["group"]["f"]) and two["grp"]["r2"] == pytest.approx(one["group"]["r2"])
    assert 0 < two["grp"]["p"] <= 1
    test = ordination.dbrda(pairs, meta, "grp", n=9)["test"].first()
    assert 0 < test["r2"] < 1 and 0 < test["p"] <= 1


def test_align_by_substring(spark):
    seqs = [[("a", "ACGT"), ("b", "GGG")], [("c", "ACGTT"), ("d", "CCC"), ("e", "CCC")]]
    objs = [{"seq": spark.createDataFrame(s, "feature string, seq string"), "tab": spark.createDataFrame([(f, "s", 1.0) for f, _ in s], TAB)} for s in seqs]
    got = [{r["feature"]: r["value"] for r in o["tab"].collect()} for o in combine.align(objs, different_lengths=True)]
    assert got == [{"SV1": 1, "SV2": 1}, {"SV1": 1, "SV3": 2}]
    assert sequences.banded(["kitten"], ["sitting"], 3).tolist() == [3]


def test_simulated_trees(spark):
    nodes, leaves = simulate.beta_splitting_tree(spark, 25, 0.0, seed=2)
    tips = nodes.where("node like 'SP%'").collect()
    assert len(tips) == 25 and all(r["dist_to_root"] == pytest.approx(1) for r in tips)
    assert leaves.where("node = 'root'").count() == 25


def test_faults_and_names(spark, toy):
    twice = toy.union(toy.limit(1))
    assert [r["rule"] for r in relational.faults(twice).collect()] == ["repeated cell"]
    order = {r["feature"]: r["ord"] for r in relational.with_order(spark.createDataFrame([("b10",), ("b9",), ("a1",), ("10x",)], "feature string")).collect()}
    assert sorted(order, key=order.get) == ["10x", "a1", "b9", "b10"]


def test_community(spark, tmp_path):
    from biotally.model import Community

    put(tmp_path, "t.csv", "id,s1,s2,Phylum\nO1,3,1,Fir\nO2,1,0,Bac\nO3,0,4,Fir\n")
    put(tmp_path, "m.csv", "sample,group\ns1,a\ns2,b\ns3,b\n")
    put(tmp_path, "t.nwk", "((O1:1,O2:1):1,(O3:1,O4:1):1);")
    put(tmp_path, "s.fa", ">O1\nAC\n>O2\nGG\n>O3\nTT\n>O9\nCC\n")
    c = Community.load(spark, tab="t.csv", meta="m.csv", tree="t.nwk", fasta="s.fa", path=str(tmp_path)).validate()
    assert c.meta.count() == 2 and c.seq.count() == 3 and c.info().first()["total"] == 9
    assert by(c.alpha(0), "sample")["s1"]["d"] == pytest.approx(2) and pair(c.beta(0, "jaccard"), "s1", "s2") == pytest.approx(2 / 3)
    one = c.subset_samples("group", ["a"])
    assert {r["feature"] for r in one.tax.collect()} == {"O1", "O2"}
    assert {r["feature"] for r in c.subset_taxa("fir", "Phylum").tab.collect()} == {"O1", "O3"}
    assert {r["node"] for r in c.prune_tree().node_leaf.collect()} >= {"O1", "O2", "O3"}
    renamed = c.rename_features(names={"O1": "X"})
    assert "X" in {r["leaf"] for r in renamed.node_leaf.collect()} and "X" in {r["feature"] for r in renamed.tab.collect()}
    assert c.merge_samples("group").tab.count() == c.tab.count()
    assert c.rarefy(2).tab.agg(F.sum("value")).first()[0] == 4
    assert len(c.save(str(tmp_path / "out"))) == 5
    both = Community.merge([c, one])
    assert both.tab.select("sample").distinct().count() == 3
    with pytest.raises(ValueError, match="tree"):
        Community(tab=c.tab, tree=c.tree.where("node <> 'O1'")).validate()


def test_deep_trees(spark):
    """Deeper than any recursion limit: a chain of 300 nodes with a tip at each."""
    rows = [("n0", None, 0.0)] + [(f"n{k}", f"n{k - 1}", 1.0) for k in range(1, 300)] + [(f"t{k}", f"n{k}", 0.5) for k in range(300)]
    tree = spark.createDataFrame(rows, "node string, parent string, branchL double")
    got = {(r["node"], r["leaf"]) for r in trees.closure(tree).collect()}
    assert got == {(f"n{a}", f"t{b}") for b in range(300) for a in range(b + 1)} | {(f"t{k}", f"t{k}") for k in range(300)}
    assert trees.closure(tree).count() == len(got)
    far = {r["node"]: r["dist_to_root"] for r in trees.dist_to_root(tree).collect()}
    assert far == {f"n{k}": float(k) for k in range(300)} | {f"t{k}": k + 0.5 for k in range(300)}


def test_kinds_of_columns(spark):
    df = spark.createDataFrame([("a", 1, 1.0, "x", True), ("b", 2, 2.5, "y", False)], "sample string, n int, v double, c string, f boolean")
    assert statistics.column_kinds(df) == (["v"], ["n", "c", "f"]) and statistics.column_kinds(df, most=1) == (["n", "v"], ["c", "f"])


def test_dbrda_options(spark):
    """All levels of a category span what all but one and the mean do, and scores
    may come from elsewhere."""
    rows = [(f"s{a}", f"s{b}", abs(a - b) / 7 + (a * b % 3) / 10) for a in range(8) for b in range(a + 1, 8)]
    pairs = spark.createDataFrame(rows, "s1 string, s2 string, value double")
    meta = spark.createDataFrame([(f"s{k}", "xyz"[k % 3], float(k * k % 5), "ab"[k % 2]) for k in range(8)], "sample string, c string, v double, h string")
    one = ordination.dbrda(pairs, meta, ["c", "v"], n=9)
    two = ordination.dbrda(pairs, meta, ["c", "v"], n=9, drop_first=False, pcoa_fn=lambda names, d: ordination.pcoa_matrix(names, d))
    assert one["test"].first().asDict() == pytest.approx(two["test"].first().asDict())
    assert two["biplot"].select("variable").distinct().count() == one["biplot"].select("variable").distinct().count() + 1
    more = ordination.dbrda(pairs, meta, ["c", "v"], condition=["h"], interactions=[("c", "v")], n=9)
    test = more["test"].first()
    assert 0 < test["constrained"] <= test["total"] and 0 < test["p"] <= 1 and more["terms"].count() == 3


def test_permanova_strata_and_interaction(spark):
    rows = [(f"s{a}", f"s{b}", 0.2 + 0.6 * (a % 2 != b % 2) + (a * b % 5) / 50) for a in range(12) for b in range(a + 1, 12)]
    pairs = spark.createDataFrame(rows, "s1 string, s2 string, value double")
    meta = spark.createDataFrame([(f"s{k}", "xy"[k % 2], "pqr"[k // 4], "uv"[k // 6]) for k in range(12)], "sample string, a string, b string, block string")
    for scheme in ("labels", "freedman-lane"):
        got = {r["term"]: r for r in ordination.permanova(pairs, meta, ["a", "b"], 99, 3, include_interaction=True, strata="block", scheme=scheme).collect()}
        assert set(got) == {"a", "b", "a:b", "Residual"} and got["a"]["df"] == 1 and got["b"]["df"] == 2 and got["a:b"]["df"] == 2 and got["Residual"]["df"] == 6
        assert got["a"]["p"] < 0.05 < got["b"]["p"]
        assert got == {r["term"]: r for r in ordination.permanova(pairs, meta, ["a", "b"], 99, 3, include_interaction=True, strata="block", scheme=scheme).collect()}
