"""Alpha diversity: one row a sample. Tables are long, with positive values only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hill import evenness as evenness_column
from ..functions.hill import from_sum, hill, is_one, term
from .relational import dealt, settled

#: In a node's place: what a cell adds to its sample without other cells.
ALONE = -1


def relative(tab: DataFrame, use_values: bool = False, tasks: int | None = None) -> DataFrame:
    """feature, sample, p: shares within a sample, or the values themselves."""
    rows = tab.where(F.col("value") > 0)
    if use_values:
        return rows.select("feature", "sample", F.col("value").cast("double").alias("p"))
    return dealt(rows, tasks, "sample").select("feature", "sample", (F.col("value") / F.sum("value").over(Window.partitionBy("sample"))).alias("p"))


def naive_alpha(tab: DataFrame, q: float = 1, use_values: bool = False, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """sample, d. Two aggregations by sample and no window: the share's total is
    a factor of the sum. ``by``: other columns that tell samples apart."""
    if use_values:
        return relative(tab, True).groupBy("sample").agg(hill(F.col("p"), q).alias("d"))
    v = F.col("value").cast("double")
    rows = tab.where(F.col("value") > 0)
    if is_one(q):
        return rows.groupBy(*by).agg(F.exp(F.ln(F.sum(v)) - F.sum(v * F.ln(v)) / F.sum(v)).alias("d"))
    return rows.groupBy(*by).agg(F.pow(F.sum(term(v, q)) / F.pow(F.sum(v), F.lit(float(q))), F.lit(1.0 / (1.0 - q))).alias("d"))


def orders(start: float, stop: float, step: float) -> list[float]:
    """An inclusive grid of orders."""
    return [round(start + k * step, 10) for k in range(int(round((stop - start) / step)) + 1)]


def _by_order(wide: DataFrame, grid: list[float]) -> DataFrame:
    """sample, d0, d1, ... -> q, sample, d."""
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"d{k}").alias("d")) for k, q in enumerate(grid)])
    return wide.select("sample", F.inline(pairs)).select("q", "sample", "d")


def alpha_profile(tab: DataFrame, start: float = 0.0, stop: float = 2.0, step: float = 0.05) -> DataFrame:
    """q, sample, d on an inclusive grid of orders: one pass, one aggregation."""
    grid = orders(start, stop, step)
    return _by_order(relative(tab).groupBy("sample").agg(*[from_sum(F.sum(term(F.col("p"), q)), q).alias(f"d{k}") for k, q in enumerate(grid)]), grid)


def phyl_profile(tab: DataFrame, tree: DataFrame, node_leaf: DataFrame, start: float = 0.0, stop: float = 2.0, step: float = 0.05) -> DataFrame:
    """q, sample, d of the phylogenetic Hill number: one aggregation for all orders."""
    grid, length = orders(start, stop, step), F.col("branchL")
    a = branch_shares(tab, node_leaf).join(tree.select("node", "branchL"), "node").where("a > 0")
    sums = a.groupBy("sample").agg(F.sum(length * F.col("a")).alias("t"), *[F.sum(length * term(F.col("a"), q)).alias(f"s{k}") for k, q in enumerate(grid)])
    return _by_order(sums.select("sample", *[from_sum(F.try_divide(F.col(f"s{k}"), F.col("t")), q).alias(f"d{k}") for k, q in enumerate(grid)]), grid)


def func_profile(tab: DataFrame, distmat: DataFrame, start: float = 0.0, stop: float = 2.0, step: float = 0.05, index: str = "FD") -> DataFrame:
    """q, sample, d as ``func_alpha``: one join with the distances for all orders."""
    if index not in ("FD", "D", "MD"):
        raise ValueError("index is FD, D or MD")
    grid = orders(start, stop, step)
    # At q 1 the logarithm of a product is a sum: p ln p on one side, p on the other.
    w = [F.col("p") if is_one(q) else term(F.col("p"), q) for q in grid]
    rows = relative(tab).select("feature", "sample", "p", *[x.alias(f"w{k}") for k, x in enumerate(w)])
    names = ["p", *[f"w{k}" for k in range(len(grid))]]
    dw = rows.join(distmat, rows["feature"] == distmat["f2"]).groupBy(F.col("f1").alias("feature"), "sample").agg(*[F.sum(F.col("d") * F.col(c)).alias(f"d_{c}") for c in names])
    own = [F.col("p") * F.ln("p") * 2 if is_one(q) else F.col(f"w{k}") for k, q in enumerate(grid)]
    sums = rows.join(dw, ["feature", "sample"]).groupBy("sample").agg(F.sum(F.col("p") * F.col("d_p")).alias("q_rao"), *[F.sum(x * F.col(f"d_w{k}")).alias(f"s{k}") for k, x in enumerate(own)])
    d = [from_sum(F.try_divide(F.col(f"s{k}"), F.col("q_rao")), q, 2.0) for k, q in enumerate(grid)]
    out = {"D": lambda x: x, "MD": lambda x: x * F.col("q_rao"), "FD": lambda x: x * x * F.col("q_rao")}[index]
    return _by_order(sums.select("sample", *[out(x).alias(f"d{k}") for k, x in enumerate(d)]), grid)


def branch_shares(tab: DataFrame, node_leaf: DataFrame, use_values: bool = False) -> DataFrame:
    """node, sample, a: the shares under each node."""
    return relative(tab, use_values).join(node_leaf.withColumnRenamed("leaf", "feature"), "feature").groupBy("node", "sample").agg(F.sum("p").alias("a"))


def mean_height(tab: DataFrame, tree: DataFrame, node_leaf: DataFrame, use_values: bool = False, tasks: int | None = None) -> DataFrame:
    """sample, t: the abundance-weighted mean height of the tree. A leaf's height
    is the same in all samples, so no row is made for a node and sample."""
    heights = node_leaf.join(tree.select("node", "branchL"), "node").groupBy(F.col("leaf").alias("feature")).agg(F.sum("branchL").alias("height"))
    rows = dealt(relative(tab, use_values, tasks), tasks, "feature").join(heights, "feature")
    return rows.groupBy("sample").agg(F.sum(F.col("p") * F.col("height")).alias("t"))


def phyl_alpha(tab: DataFrame, tree: DataFrame, node_leaf: DataFrame, q: float = 1, index: str = "D", use_values: bool = False, tasks: int | None = None) -> DataFrame:
    """sample, d: phylogenetic Hill number D, its product with the height PD, or
    the sum H it comes from.

    Cells are dealt by samples with the numbers of their feature's nodes, and
    are only there spread over them. Values are summed by node and sample only
    for nodes of several leaves; the others, which are most, have their leaf's and
    are added up by sample. A sample's total is a factor of its sums, as in
    ``naive_alpha``."""
    nodes = node_leaf.groupBy("node").agg(F.count(F.lit(1)).alias("leaves"), F.first("leaf").alias("feature")).join(tree.select("node", "branchL"), "node")
    nodes = settled(nodes.withColumn("id", F.monotonically_increasing_id()))
    own = nodes.where("leaves = 1").select("feature", F.lit(None).cast("long").alias("id"), "branchL")
    shared = node_leaf.join(nodes.where("leaves > 1").select("node", "id", "branchL"), "node").select(F.col("leaf").alias("feature"), "id", "branchL")
    above = dealt(own.unionByName(shared), tasks, "feature").groupBy("feature").agg(F.collect_list("id").alias("ids"), F.collect_list(F.when(F.col("id").isNotNull(), F.col("branchL"))).alias("lengths"), F.sum(F.when(F.col("id").isNull(), F.col("branchL"))).alias("lone"))
    length, v, lone = F.col("branchL"), F.col("v"), F.col("id") == ALONE
    values = tab.where("value > 0").select("feature", "sample", F.col("value").cast("double").alias("v"))
    rows = dealt(values.join(above, "feature", "left").select("sample", "v", "lone", "ids", "lengths"), tasks, "sample")
    # One more row a cell has its part in the total and in nodes of its own.
    rows = rows.select("sample", "v", F.inline(F.concat(F.array(F.struct(F.lit(ALONE).cast("long").alias("id"), F.col("lone").alias("branchL"))), F.coalesce(F.arrays_zip(F.col("ids").alias("id"), F.col("lengths").alias("branchL")), F.array().cast("array<struct<id:bigint,branchL:double>>")))))
    rows = rows.select("sample", "id", F.when(~lone, length).alias("branchL"), "v", F.when(lone, length * v).alias("t"), F.when(lone, length * term(v, q)).alias("s"))
    a = rows.groupBy("sample", "id", "branchL").agg(F.sum("v").alias("v"), F.sum("t").alias("t"), F.sum("s").alias("s"))
    sums = a.groupBy("sample").agg(F.sum(F.coalesce("t", length * v)).alias("t"), F.sum(F.coalesce("s", length * term(v, q))).alias("s"), F.sum(F.when(lone, v)).alias("total")).where("t is not null")
    total = F.lit(1.0) if use_values else F.col("total")
    sums = sums if use_values else sums.where("sample is not null")
    t = F.col("t") / total
    s = (F.col("s") - F.ln(total) * F.col("t")) / total if is_one(q) else F.col("s") / F.pow(total, F.lit(float(q)))
    sums = sums.select("sample", t.alias("t"), s.alias("s"))
    h = F.try_divide(F.col("s"), F.col("t"))
    d = from_sum(h, q)
    out = {"D": d, "PD": d * F.col("t"), "H": h}
    if index not in out:
        raise ValueError("index is D, PD or H")
    return sums.select("sample", out[index].alias("d"))


def by_distance(weights: DataFrame, distmat: DataFrame, keys: list[str]) -> DataFrame:
    """(feature, sample, w) x (f1, f2, d) -> for each f1 and key the sum of d w:
    the inner product that every quadratic form below is read from."""
    return weights.join(distmat, weights["feature"] == distmat["f2"]).groupBy("f1", *keys).agg(F.sum(F.col("d") * F.col("w")).alias("dw"))


def gram(left: DataFrame, right: DataFrame, distmat: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, s1, s2, g = sum over features of w1 d w2. Inputs have keys,
    feature, sample, w."""
    dw = by_distance(right, distmat, [*keys, "sample"]).withColumnRenamed("sample", "s2").withColumnRenamed("f1", "feature")
    a = left.select(*keys, "feature", F.col("sample").alias("s1"), "w")
    return a.join(dw, [*keys, "feature"]).groupBy(*keys, "s1", "s2").agg(F.sum(F.col("w") * F.col("dw")).alias("g"))


def _diagonal(weights: DataFrame, right: DataFrame, distmat: DataFrame) -> DataFrame:
    dw = by_distance(right, distmat, ["sample"]).select(F.col("f1").alias("feature"), "sample", "dw")
    return weights.join(dw, ["feature", "sample"]).groupBy("sample").agg(F.sum(F.col("w") * F.col("dw")).alias("g"))


def rao(tab: DataFrame, distmat: DataFrame) -> DataFrame:
    """sample, q_rao: Rao's quadratic entropy."""
    w = relative(tab).withColumnRenamed("p", "w")
    out = _diagonal(w, w, distmat).withColumnRenamed("g", "q_rao")
    return w.select("sample").distinct().join(out, "sample", "left").select("sample", F.coalesce("q_rao", F.lit(0.0)).alias("q_rao"))


def func_alpha(tab: DataFrame, distmat: DataFrame, q: float = 1, index: str = "FD") -> DataFrame:
    """sample, d: functional Hill number D, MD = D Q or FD = D MD."""
    p = relative(tab)
    w = p.withColumnRenamed("p", "w")
    quad = _diagonal(w, w, distmat).withColumnRenamed("g", "q_rao")
    if is_one(q):
        logs = p.select("feature", "sample", (F.col("p") * F.ln("p")).alias("w"))
        # ln(p_i p_j) is a sum, and distances are symmetric.
        sums = _diagonal(logs, w, distmat).select("sample", (F.col("g") * 2).alias("s"))
    else:
        powers = p.select("feature", "sample", F.pow("p", F.lit(float(q))).alias("w"))
        sums = _diagonal(powers, powers, distmat).withColumnRenamed("g", "s")
    d = from_sum(F.try_divide(F.col("s"), F.col("q_rao")), q, 2.0)
    out = {"D": d, "MD": d * F.col("q_rao"), "FD": d * d * F.col("q_rao")}
    if index not in out:
        raise ValueError("index is FD, D or MD")
    return quad.join(sums, "sample").select("sample", out[index].alias("d"))


def powers(tab: DataFrame, q: float) -> DataFrame:
    """feature, sample, w = p^q."""
    return relative(tab).select("feature", "sample", F.pow("p", F.lit(float(q))).alias("w"))


def mpd(tab: DataFrame, distmat: DataFrame, q: float = 1) -> DataFrame:
    """sample, mpd: mean pairwise distance; null with fewer than two features."""
    w = powers(tab, q)
    size = w.groupBy("sample").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("w")).alias("z2"), F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n") >= 2, F.try_divide(F.coalesce("g", F.lit(0.0)), F.col("z") * F.col("z") - F.col("z2")))
    return size.join(_diagonal(w, w, distmat), "sample", "left").select("sample", value.alias("mpd"))


def nearest(tab: DataFrame, other: DataFrame, distmat: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, s1, s2, feature, w, near: for each feature of s1 the nearest other
    feature of s2. Inputs have keys, feature, sample, w."""
    a = tab.select(*keys, F.col("feature").alias("f1"), F.col("sample").alias("s1"), "w")
    b = other.select(*keys, F.col("feature").alias("f2"), F.col("sample").alias("s2"))
    return a.join(distmat.where("f1 <> f2"), "f1").join(b, [*keys, "f2"]).groupBy(*keys, "s1", "s2", F.col("f1").alias("feature"), "w").agg(F.min("d").alias("near"))


def mntd(tab: DataFrame, distmat: DataFrame, q: float = 1) -> DataFrame:
    """sample, mntd: mean nearest-taxon distance; null with fewer than two features."""
    w = powers(tab, q)
    a = w.select(F.col("feature").alias("f1"), "sample", "w")
    b = w.select(F.col("feature").alias("f2"), F.col("sample").alias("other"))
    pairs = a.join(distmat.where("f1 <> f2"), "f1")
    near = pairs.join(b, (pairs["f2"] == b["f2"]) & (pairs["sample"] == b["other"])).groupBy("sample", "f1", "w").agg(F.min("d").alias("near"))
    out = near.groupBy("sample").agg((F.sum(F.col("w") * F.col("near")) / F.sum("w")).alias("mntd"))
    return w.select("sample").distinct().join(out, "sample", "left")


def evenness(tab: DataFrame, q: float = 1, index: str = "CR1", *, div_type: str = "naive", perspective: str = "samples", tree: DataFrame | None = None, node_leaf: DataFrame | None = None, distmat: DataFrame | None = None) -> DataFrame:
    """(sample or feature, evenness). For taxa, the types are the samples, all
    of them counted whether the taxon is there or not."""
    if perspective == "samples":
        d = {"naive": lambda: naive_alpha(tab, q), "phyl": lambda: phyl_alpha(tab, tree, node_leaf, q, "D"), "func": lambda: func_alpha(tab, distmat, q, "D")}[div_type]()
        s = tab.where("value > 0").groupBy("sample").agg(F.count(F.lit(1)).cast("double").alias("s"))
        return d.join(s, "sample").select("sample", evenness_column(F.col("d"), F.col("s"), q, index).alias("evenness"))
    if div_type == "func":
        raise ValueError("taxa have naive and phyl evenness only")
    n = tab.agg(F.countDistinct("sample").cast("double").alias("s"))
    if div_type == "phyl":
        a = branch_shares(tab, node_leaf).select(F.col("node").alias("sample"), F.col("sample").alias("feature"), F.col("a").alias("value"))
    else:
        a = tab.select(F.col("feature").alias("sample"), F.col("sample").alias("feature"), "value")
    # One row of counts beside each taxon.
    return naive_alpha(a, q).join(F.broadcast(n)).select(F.col("sample").alias("feature"), evenness_column(F.col("d"), F.col("s"), q, index).alias("evenness"))
