"""Tree distances, pruning and midpoint rooting on tables, against plain walks."""

import random

import pytest

from biotally.operators import trees

NODES = "node string, parent string, branchL double"


def drawn(seed, n=60, deep=False, zero=0.1):
    """A random tree with chains of single children, zero lengths and stars."""
    rng = random.Random(seed)
    rows = [("n0", None, 0.0)]
    for k in range(1, n):
        up = rows[-1][0] if deep and rng.random() < 0.8 else rng.choice(rows)[0]
        rows.append((f"n{k}", up, 0.0 if rng.random() < zero else round(rng.random(), 3)))
    rng.shuffle(rows)
    return rows


def parents(rows):
    return {n: (p, d) for n, p, d in rows}


def line(up, n):
    out = [n]
    while up[n][0] is not None:
        n = up[n][0]
        out.append(n)
    return out


def leaves_of(rows):
    inner = {p for _, p, _ in rows}
    return sorted(n for n, _, _ in rows if n not in inner)


def distance(up, a, b):
    one, two = line(up, a), line(up, b)
    shared = set(one) & set(two)
    return sum(up[n][1] for n in {*one, *two} - shared)


def frame(spark, rows):
    df = spark.createDataFrame(rows, NODES)
    return df, trees.closure(df)


@pytest.mark.parametrize(("seed", "deep", "block"), [(1, False, 512), (2, True, 4), (3, False, 1), (4, True, 3), (5, False, 7)])
def test_distances(spark, monkeypatch, seed, deep, block):
    monkeypatch.setattr(trees, "BLOCK", block)
    rows = drawn(seed, deep=deep)
    up, tips = parents(rows), leaves_of(rows)
    got = trees.tree_distance(*frame(spark, rows)).collect()
    assert len(got) == len(tips) * (len(tips) - 1) // 2
    for r in got:
        assert r["f1"] < r["f2"]
        assert r["d"] == pytest.approx(distance(up, r["f1"], r["f2"]), abs=1e-9)


def test_tour(spark):
    rows = drawn(8)
    up, tips = parents(rows), leaves_of(rows)
    got = {r["node"]: r for r in trees.tour(*frame(spark, rows)).collect()}
    assert sorted(got[t]["first"] for t in tips) == list(range(len(tips)))
    for n, _, _ in rows:
        own = {t for t in tips if n in line(up, t)}
        assert {t for t in tips if got[n]["first"] <= got[t]["first"] < got[n]["first"] + got[n]["leaves"]} == own
        assert got[n]["depth"] == pytest.approx(sum(up[x][1] for x in line(up, n)[:-1]))


def test_forest_and_small_trees(spark):
    rows = [("a", None, 9.0), ("b", "a", 1.0), ("c", "a", 2.0), ("x", "gone", 5.0), ("y", "x", 1.0), ("z", "x", 0.5), ("lone", None, 0.0)]
    df = spark.createDataFrame(rows, NODES)
    found = trees.closure(df.where("node <> 'x'").unionByName(spark.createDataFrame([("x", None, 0.0)], NODES)))
    got = {(r["f1"], r["f2"]): r["d"] for r in trees.tree_distance(df, found).collect()}
    assert got == {("b", "c"): 3.0, ("y", "z"): 1.5}
    one, leaf = frame(spark, [("r", None, 0.0)])
    assert trees.tree_distance(one, leaf).collect() == []
    assert trees.tree_distance(one.limit(0), leaf.limit(0)).collect() == []
    assert [tuple(r) for r in trees.reroot_midpoint(one, leaf).collect()] == [("r", None, 0.0)]


def plain_prune(rows, keep):
    up = parents(rows)
    kept = {n for t in keep for n in line(up, t)}
    children = {}
    for n in kept:
        children.setdefault(up[n][0], []).append(n)
    multi = {n for n in kept if n in keep or len(children.get(n, [])) > 1}
    out = {}
    for n in multi:
        at, d = n, up[n][1]
        at = up[n][0]
        while at is not None and at not in multi:
            d, at = d + up[at][1], up[at][0]
        out[n] = (at, d if at is not None else 0.0)
    return out


@pytest.mark.parametrize(("seed", "deep", "share"), [(1, False, 0.5), (2, True, 0.5), (3, False, 0.2), (4, True, 1.0), (5, True, 0.15)])
def test_prune(spark, seed, deep, share):
    rows = drawn(seed, deep=deep)
    rng = random.Random(seed)
    tips = leaves_of(rows)
    keep = [t for t in tips if rng.random() < share] or tips[:2]
    got = {r["node"]: (r["parent"], r["branchL"]) for r in trees.prune(*frame(spark, rows), spark.createDataFrame([(k,) for k in [*keep, "none"]], "feature string")).collect()}
    want = plain_prune(rows, set(keep))
    if len(keep) > 1:
        assert got.keys() == want.keys()
        for n, (p, d) in want.items():
            assert got[n][0] == p and got[n][1] == pytest.approx(d)


def test_prune_to_one_leaf_or_none(spark):
    rows = [("r", None, 0.0), ("a", "r", 1.0), ("b", "a", 2.0), ("c", "a", 3.0), ("d", "r", 1.0)]
    df, found = frame(spark, rows)
    keep = lambda *names: spark.createDataFrame([(n,) for n in names], "feature string")
    assert sorted(tuple(r) for r in trees.prune(df, found, keep("b")).collect()) == [("b", "r", 3.0), ("r", None, 0.0)]
    assert sorted(tuple(r) for r in trees.prune(df, found, keep("b", "c")).collect()) == [("a", None, 0.0), ("b", "a", 2.0), ("c", "a", 3.0)]
    assert trees.prune(df, found, keep("none")).collect() == []


@pytest.mark.parametrize(("seed", "deep"), [(1, False), (2, True), (3, False), (4, True), (6, False)])
def test_midpoint(spark, seed, deep):
    """Paths between leaves stay; the two sides are as high as half the longest."""
    rows = drawn(seed, 50, deep, zero=0.0)
    pruned = [(n, p, d) for n, (p, d) in plain_prune(rows, set(leaves_of(rows))).items()]
    up, tips = parents(pruned), leaves_of(pruned)
    longest = max(distance(up, a, b) for a in tips for b in tips)
    got = [tuple(r) for r in trees.reroot_midpoint(*frame(spark, pruned)).collect()]
    new = parents(got)
    assert len(new) == len(got) and sum(p is None for p, _ in new.values()) == 1
    assert {n for n in new if n != "in_midroot"} == set(up)
    assert {*leaves_of(got)} >= set(tips)
    for a in tips:
        for b in tips:
            assert distance(new, a, b) == pytest.approx(distance(up, a, b))
    heights = sorted((sum(new[x][1] for x in line(new, t)[:-1]) for t in tips), reverse=True)
    assert heights[0] == pytest.approx(longest / 2)
    root = next(n for n, (p, _) in new.items() if p is None)
    sides = {}
    for t in tips:
        path = line(new, t)
        if path[-1] == root and len(path) > 1:
            sides[path[-2]] = max(sides.get(path[-2], 0), sum(new[x][1] for x in path[:-1]))
    assert sorted(sides.values())[-2] == pytest.approx(longest / 2)


def test_midpoint_at_a_node(spark):
    rows = [("r", None, 0.0), ("a", "r", 1.0), ("b", "a", 3.0), ("c", "a", 3.0), ("in_midroot", "r", 0.5)]
    got = {r["node"]: (r["parent"], r["branchL"]) for r in trees.reroot_midpoint(*frame(spark, rows)).collect()}
    assert got == {"a": (None, 0.0), "r": ("a", 1.0), "b": ("a", 3.0), "c": ("a", 3.0), "in_midroot": ("r", 0.5)}
    rows = [("r", None, 0.0), ("a", "r", 5.0), ("in_midroot", "r", 1.0)]
    got = {r["node"]: (r["parent"], r["branchL"]) for r in trees.reroot_midpoint(*frame(spark, rows)).collect()}
    assert got == {"in_midroot1": (None, 0.0), "a": ("in_midroot1", 3.0), "r": ("in_midroot1", 2.0), "in_midroot": ("r", 1.0)}
