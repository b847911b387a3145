"""Trees as tables: closures, distances, subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import running, settled


def closure(tree: DataFrame) -> DataFrame:
    """(node, parent, branchL) -> (node, leaf), by jumps that double: a tree of
    depth d takes log2(d) rounds, however deep and large it is."""
    jump = settled(tree.where("parent is not null").select("node", F.col("parent").alias("up")))
    parents = tree.select(F.col("parent").alias("node")).where("node is not null").distinct()
    found = settled(tree.select("node").join(parents, "node", "left_anti").select("node", F.col("node").alias("leaf")))
    while not jump.isEmpty():
        # Ancestors less than one jump away are known; a jump from each gives the next.
        found = settled(found.unionByName(found.join(jump, "node").select(F.col("up").alias("node"), "leaf")))
        onward = jump.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = settled(jump.join(onward, "up").select("node", F.col("top").alias("up")))
    return found


def dist_to_root(tree: DataFrame) -> DataFrame:
    """(node, parent, branchL) -> (node, dist_to_root), by jumps that double."""
    jump = settled(tree.select("node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(F.col("branchL")).alias("d")))
    while not jump.where("up is not null").isEmpty():
        onward = jump.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
        jump = settled(jump.join(onward, "up", "left").select("node", F.col("top").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0.0))).alias("d")))
    return jump.select("node", F.col("d").alias("dist_to_root"))


def tour(tree: DataFrame, node_leaf: DataFrame) -> DataFrame:
    """node, parent, branchL, leaves (how many it has), first (how many come
    before it) and depth (distance to its root): a walk through the tree that
    takes children by name. A node's leaves are those from ``first`` on.

    A node comes after the leaves of its earlier siblings; these offsets, and
    lengths, are summed up to the root by jumps that double."""
    known = tree.select(F.col("node").alias("parent")).distinct().withColumn("known", F.lit(True))
    rows = tree.select("node", "parent", "branchL").join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.col("branchL").cast("double").alias("branchL"))
    sizes = node_leaf.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"))
    ordered = settled(running(rows.join(sizes, "node"), "upto", [F.col("parent").asc_nulls_first(), F.col("node")], "leaves"))
    base = ordered.groupBy(F.col("parent").alias("of")).agg(F.min(F.col("upto") - F.col("leaves")).alias("base"))
    own = ordered.join(base, F.col("parent").eqNullSafe(F.col("of"))).select("node", "parent", (F.col("upto") - F.col("leaves") - F.when(F.col("parent").isNull(), 0).otherwise(F.col("base"))).alias("first"), F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(F.col("branchL")).alias("depth"))
    jump = settled(own.withColumnRenamed("parent", "up"))
    while not jump.where("up is not null").isEmpty():
        onward = jump.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("first").alias("more"), F.col("depth").alias("further"))
        jump = settled(jump.join(onward, "up", "left").select("node", F.col("top").alias("up"), (F.col("first") + F.coalesce("more", F.lit(0))).alias("first"), (F.col("depth") + F.coalesce("further", F.lit(0.0))).alias("depth")))
    return ordered.select("node", "parent", "branchL", "leaves").join(jump.select("node", "first", "depth"), "node")


def leaf_row(walk: DataFrame, node_leaf: DataFrame) -> DataFrame:
    """leaf, pos, depth, gap: the leaves in the order of the walk (``tour``), and
    how deep the last node is that each shares with the leaf before it. The
    deepest node that two leaves share is as deep as the least gap between them."""
    tips = node_leaf.where("node = leaf").select("leaf")
    leaves = walk.join(tips, walk["node"] == tips["leaf"], "left_semi").select(F.col("node").alias("leaf"), F.col("first").alias("pos"), "depth")
    up = walk.select(F.col("node").alias("parent"), F.col("first").alias("start"), F.col("depth").alias("gap"))
    # Children that are not a node's first; trees of a forest share nothing.
    inner = walk.join(up, "parent").where("first > start").select(F.col("first").alias("pos"), "gap")
    forest = walk.where("parent is null").select(F.col("first").alias("pos"), F.lit(float("-inf")).alias("gap"))
    return leaves.join(inner.unionByName(forest), "pos")


#: Leaves of a block; a tile of two blocks is one row for a task.
BLOCK = 512


def _between(mins: DataFrame, n: int) -> DataFrame:
    """(a, b, between) for blocks a <= b: the least of the blocks between, from a
    sparse table: minima of 1, 2, 4, ... blocks from each on, two of which cover
    any run."""
    level, table = mins.select(F.lit(0).alias("level"), "block", "least"), None
    width, k = 1, 0
    while True:
        table = level if table is None else table.unionByName(level)
        if 2 * width > n:
            break
        onward = level.select((F.col("block") - width).alias("block"), F.col("least").alias("onward"))
        level = level.join(onward, "block").select(F.lit(k + 1).alias("level"), "block", F.least("least", "onward").alias("least"))
        width, k = 2 * width, k + 1
    table = settled(table)
    pairs = mins.select(F.col("block").alias("a"), F.explode(F.sequence(F.col("block"), F.lit(n - 1).cast("long"))).alias("b"))
    run = F.col("b") - F.col("a") - 1
    pairs = pairs.withColumn("level", F.when(run > 0, F.floor(F.log2(run.cast("double") + 0.5)).cast("int")))
    left = table.select("level", (F.col("block") - 1).alias("a"), F.col("least").alias("l1"))
    right = table.select("level", (F.col("block") + F.pow(F.lit(2.0), F.col("level")).cast("long")).alias("b"), F.col("least").alias("l2"))
    met = pairs.join(left, ["level", "a"], "left").join(right, ["level", "b"], "left")
    return met.select("a", "b", F.least("l1", "l2").alias("between"))


def _tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for r in range(batch.num_rows):
            cell = {c: batch.column(c)[r] for c in batch.schema.names}
            one, two = (cell[f"leaves_{x}"].values for x in "ab")
            da, db, ga, gb = (np.asarray(cell[c].values, dtype=float) for c in ("depths_a", "depths_b", "gaps_a", "gaps_b"))
            if cell["a"].as_py() == cell["b"].as_py():
                least = np.full((len(da), len(da)), np.inf)
                for i in range(len(da) - 1):
                    least[i, i + 1 :] = np.minimum.accumulate(ga[i + 1 :])
                i, j = np.triu_indices(len(da), 1)
            else:
                behind = np.append(np.minimum.accumulate(ga[:0:-1])[::-1], np.inf) if len(ga) > 1 else np.array([np.inf])
                between = cell["between"].as_py()
                least = np.minimum(np.minimum.outer(behind, np.minimum.accumulate(gb)), np.inf if between is None else between)
                i, j = (x.ravel() for x in np.indices(least.shape))
            c = least[i, j]
            ok = np.isfinite(c)
            i, j, c = i[ok], j[ok], c[ok]
            yield pa.RecordBatch.from_arrays([one.take(pa.array(i)), two.take(pa.array(j)), pa.array(da[i] + db[j] - 2 * c)], names=["x", "y", "d"])


def tree_distance(tree: DataFrame, node_leaf: DataFrame) -> DataFrame:
    """f1 < f2, d: the path between two leaves of a tree.

    Leaves stand in a row (``leaf_row``), cut into blocks; a tile of two blocks
    has the pairs of their leaves, and what they share from running minima within
    the blocks and the least of those between. A block is sent once a tile; no
    pair is made before its distance is known."""
    row = settled(leaf_row(tour(tree, node_leaf), node_leaf))
    block = F.floor(F.col("pos") / BLOCK)
    mins = settled(row.groupBy(block.alias("block")).agg(F.min("gap").alias("least")))
    n = mins.count()
    if not n:
        return tree.sparkSession.createDataFrame([], "f1 string, f2 string, d double")
    cells = row.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "depth", "gap"))).alias("c"))
    cells = settled(cells.select("block", F.col("c.leaf").alias("leaves"), F.col("c.depth").alias("depths"), F.col("c.gap").alias("gaps")))
    side = lambda x: cells.select(F.col("block").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("leaves", "depths", "gaps")])
    tiles = _between(mins, n).join(side("a"), "a").join(side("b"), "b")
    pairs = tiles.mapInArrow(_tiles, "x string, y string, d double")
    return pairs.select(F.least("x", "y").alias("f1"), F.greatest("x", "y").alias("f2"), "d")


def prune(tree: DataFrame, node_leaf: DataFrame, keep: DataFrame) -> DataFrame:
    """node, parent, branchL of the tree over the kept leaves (``keep`` has
    feature). A node with one child left is merged into it, lengths added; the
    chains of such nodes are crossed by jumps that double. The root is the first
    node with two children left; with a single leaf, it stays above it."""
    left = settled(subset_tree_rows(tree.select("node", "parent", "branchL"), node_leaf, keep).drop("n_leaves"))
    roots = left.join(left.select(F.col("node").alias("parent")), "parent", "left_anti").select("node")
    left = left.join(roots.withColumn("top", F.lit(True)), "node", "left").select("node", F.when(F.col("top").isNull(), F.col("parent")).alias("parent"), F.when(F.col("top").isNull(), F.col("branchL")).otherwise(F.lit(0.0)).alias("branchL"))
    children = left.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    single = children.where("n = 1").select("node")
    jump = settled(left.join(single, "node", "left_semi").select("node", F.col("parent").alias("up"), F.col("branchL").alias("d")))
    ends = jump.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
    while not jump.join(ends.select("up"), "up", "left_semi").isEmpty():
        jump = settled(jump.join(ends, "up", "left").select("node", F.when(F.col("more").isNull(), F.col("up")).otherwise(F.col("top")).alias("up"), (F.col("d") + F.coalesce("more", F.lit(0.0))).alias("d")))
        ends = jump.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
    crossed = jump.select(F.col("node").alias("parent"), F.col("up"), F.col("d"), F.lit(True).alias("chain"))
    out = left.join(single, "node", "left_anti").join(crossed, "parent", "left")
    out = settled(out.select("node", F.when(F.col("chain"), F.col("up")).otherwise(F.col("parent")).alias("parent"), (F.col("branchL") + F.coalesce("d", F.lit(0.0))).alias("branchL")))
    # What has come to the top ends there; a lone leaf keeps its root.
    if out.limit(2).count() == 1:
        return out.crossJoin(roots.select(F.col("node").alias("root"))).select(F.explode(F.array(F.struct(F.col("root").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("branchL")), F.struct("node", F.when(F.col("node") != F.col("root"), F.col("root")).alias("parent"), "branchL"))).alias("r")).select("r.*").distinct()
    return out.withColumn("branchL", F.when(F.col("parent").isNull(), F.lit(0.0)).otherwise(F.col("branchL")))


def _farthest(row: DataFrame, pos: int, depth: float) -> dict:
    """leaf, pos, depth, shared, d of the leaf farthest from the one at ``pos``;
    ties go to the smaller name."""
    ahead = running(row.where(F.col("pos") > pos), "shared", ["pos"], "gap", "min")
    # Behind, the gaps between are those after each leaf.
    after = row.select((F.col("pos") - 1).alias("pos"), F.col("gap").alias("after"))
    back = running(row.where(F.col("pos") < pos).join(after, "pos"), "shared", [F.desc("pos")], "after", "min")
    both = ahead.select("leaf", "pos", "depth", "shared").unionByName(back.select("leaf", "pos", "depth", "shared")).where(F.col("shared") > float("-inf"))
    found = both.withColumn("d", F.lit(depth) + F.col("depth") - F.col("shared") * 2).orderBy(F.desc("d"), "leaf").limit(1).collect()
    return found[0].asDict() if found else {}


def reroot_midpoint(tree: DataFrame, node_leaf: DataFrame, tol: float = 1e-12) -> DataFrame:
    """node, parent, branchL of the tree rooted halfway between its two farthest
    leaves: at the node that stands there, or at a new one, in_midroot.

    The leaf farthest from any leaf is an end of a longest path, and the leaf
    farthest from that the other; both are sweeps of running minima over the row
    of leaves. The nodes between the middle and the old root, those whose leaves
    include an end, turn round."""
    walk = settled(tour(tree, node_leaf))
    row = settled(leaf_row(walk, node_leaf))
    plain = walk.select("node", F.col("parent"), "branchL")
    start = row.where("pos = 0").collect()
    one = _farthest(row, 0, start[0]["depth"]) if start else {}
    two = _farthest(row, one["pos"], one["depth"]) if one else {}
    if not two or two["d"] <= tol:
        return plain
    deep = max((one, two), key=lambda x: x["depth"])
    at = deep["depth"] - two["d"] / 2
    line = settled(walk.where((F.col("first") <= deep["pos"]) & (F.col("first") + F.col("leaves") > deep["pos"])))
    found = line.where(F.abs(F.col("depth") - at) <= tol).orderBy(F.desc("leaves")).limit(1).collect()
    if found:
        name, turned, ends = found[0]["node"], line.where((F.col("leaves") >= found[0]["leaves"]) & (F.col("depth") <= found[0]["depth"])), []
    else:
        below = line.where(F.col("depth") > at).orderBy("depth", F.desc("leaves")).limit(1).collect()[0]
        above = line.where(F.col("node") == below["parent"]).collect()[0]
        turned = line.where((F.col("leaves") >= above["leaves"]) & (F.col("depth") <= above["depth"]))
        taken = {r[0] for r in walk.where(F.col("node").rlike("^in_midroot[0-9]*$")).select("node").collect()}
        name = next(n for n in ["in_midroot", *(f"in_midroot{k}" for k in range(1, len(taken) + 2))] if n not in taken)
        ends = [(name, None, 0.0), (below["node"], name, below["depth"] - at), (above["node"], name, at - above["depth"])]
    # A node that turns round hangs from its child on the line.
    under = turned.select(F.col("parent").alias("node"), F.col("node").alias("child"), F.col("branchL").alias("length")).where("node is not null")
    moved = turned.select("node").join(under, "node", "left").select("node", F.col("child").alias("parent"), F.coalesce("length", F.lit(0.0)).alias("branchL"))
    if ends:
        fixed = tree.sparkSession.createDataFrame(ends, "node string, parent string, branchL double")
        moved = moved.where(F.col("node") != ends[2][0]).unionByName(fixed)
    return plain.join(moved.select("node"), "node", "left_anti").unionByName(moved)


def mirrored(distmat: DataFrame) -> DataFrame:
    """Upper triangle -> both triangles; the diagonal stays implicit."""
    return distmat.select("f1", "f2", "d").unionByName(distmat.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "d"))


def subset_tree_rows(tree: DataFrame, node_leaf: DataFrame, keep: DataFrame) -> DataFrame:
    """The nodes with a kept leaf (``keep`` has feature) and how many they have."""
    kept = node_leaf.join(keep.select(F.col("feature").alias("leaf")).distinct(), "leaf", "left_semi")
    return tree.join(kept.groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves")), "node")


def collapse_single_children(tree: DataFrame, node_leaf: DataFrame) -> DataFrame:
    """Nodes over the same leaves become one: leaves (sorted, comma-joined) and
    their summed length. A row holds a node's leaves; ``prune`` collapses the same
    chains by name alone."""
    sets = node_leaf.groupBy("node").agg(F.array_join(F.sort_array(F.collect_list("leaf")), ",").alias("leaves"))
    return sets.join(tree.select("node", "branchL"), "node").groupBy("leaves").agg(F.sum("branchL").alias("branchL"))


def rename_leaves(tree: DataFrame, mapping: DataFrame, allow_partial: bool = True) -> DataFrame:
    """Tips renamed by (old, new); others keep their names. Raises if two nodes
    would share one, and, without ``allow_partial``, if an old name is no tip's."""
    inner = tree.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("inner", F.lit(True))
    if not allow_partial:
        tips = tree.select("node").join(inner, "node", "left_anti").select(F.col("node").alias("old"))
        if absent := [r[0] for r in mapping.select("old").join(tips, "old", "left_anti").orderBy("old").limit(10).collect()]:
            raise ValueError(f"no leaves of the tree: {absent}")
    named = tree.join(inner, "node", "left").join(mapping.select(F.col("old").alias("node"), "new"), "node", "left")
    out = named.select(F.when(F.col("inner").isNull(), F.coalesce("new", "node")).otherwise(F.col("node")).alias("node"), "parent", "branchL")
    if out.groupBy("node").count().where("count > 1").limit(1).count():
        raise ValueError("two nodes would have the same name")
    return out
