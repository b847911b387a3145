"""Beta diversity between pairs and among groups of samples.

Pairs come from features that two samples share: the rest of a pair's pooled
sum follows from each sample's own, so no pair of samples is ever spread over
all features. Pairs without a shared feature are added from the list of samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hill import dissimilarity, from_sum, is_one, term
from ..functions.hill import evenness as evenness_column
from . import pairwise
from .alpha import branch_shares, by_distance, gram, nearest, powers, relative
from .relational import settled
from .tiles import Kernel, split_sums


def pair_spine(samples: DataFrame) -> DataFrame:
    """s1 < s2 for all pairs: the result has a row for each."""
    s = samples.select("sample").distinct()
    return s.select(F.col("sample").alias("s1")).join(s.select(F.col("sample").alias("s2")), F.col("s1") < F.col("s2"))


def shared_sums(rows: DataFrame, key: str, total: Column) -> DataFrame:
    """s1 < s2, x: the sum of ``total`` over the keys that two samples share.

    ``rows`` has key, sample and further columns, which ``total`` names with a 1
    or 2 behind for either sample. This is the widest join of all: what concerns
    one sample alone is computed before it.
    """
    cols = [c for c in rows.columns if c not in (key, "sample")]
    a = rows.select(key, F.col("sample").alias("s1"), *[F.col(c).alias(f"{c}1") for c in cols])
    b = rows.select(key, F.col("sample").alias("s2"), *[F.col(c).alias(f"{c}2") for c in cols])
    return a.join(b, key).where("s1 < s2").groupBy("s1", "s2").agg(total.alias("x"))


def _shared(rows: DataFrame, key: str, total: Column, kernel: Kernel, tiled: bool) -> DataFrame:
    """``shared_sums``, or by tiles for keys of many samples; ``kernel`` is what
    ``total`` adds up, on arrays."""
    return split_sums(rows, key, lambda own: shared_sums(own, key, total), kernel) if tiled else shared_sums(rows, key, total)


def _beyond_arrays(q: float, weighted: bool = False) -> Kernel:
    """``_beyond`` on arrays of half, part (and branchL)."""

    def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        both = a[0] + b[0]
        x = (both * np.log(both) if is_one(q) else np.ones_like(both) if q == 0 else both**q) - a[1] - b[1]
        return a[2] * x if weighted else x

    return kernel


def _with_spine(pairs: DataFrame, totals: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """All pairs with both samples' totals (columns suffixed 1 and 2)."""
    names = [c for c in totals.columns if c != "sample"]
    one = totals.select(F.col("sample").alias("s1"), *[F.col(c).alias(f"{c}1") for c in names])
    two = totals.select(F.col("sample").alias("s2"), *[F.col(c).alias(f"{c}2") for c in names])
    return (pair_spine(totals) if spine is None else spine).join(one, "s1").join(two, "s2").join(pairs, ["s1", "s2"], "left")


def _beyond(q: float) -> Column:
    """What a shared feature adds to the pooled sum beyond its parts; columns are
    the halved shares and their terms."""
    return term(F.col("half1") + F.col("half2"), q) - F.col("part1") - F.col("part2")


def _summed(tab: DataFrame, repeated: bool) -> DataFrame:
    """A row for each cell."""
    return tab.groupBy("feature", "sample").agg(F.sum("value").alias("value")) if repeated else tab


def naive_beta(tab: DataFrame, q: float = 1, dis: bool = True, viewpoint: str = "regional", use_values: bool = False, spine: DataFrame | None = None, tiled: bool = False, repeated: bool = False) -> DataFrame:
    """s1, s2, value. All pairs of a table's samples come by blocks
    (``pairwise``), those of a ``spine`` by a join; ``tiled``: by a join, but for
    features that many samples share. ``repeated``: rows of a cell add up."""
    if spine is None and not tiled and (found := pairwise.all_pairs(tab, pairwise.naive(q), not use_values, repeated=repeated)) is not None:
        beta = F.col("value")
        return found.select("s1", "s2", (dissimilarity(beta, q, 2.0, "naive", viewpoint) if dis else beta).alias("value"))
    tab = _summed(tab, repeated)
    p = relative(tab, use_values)
    totals = p.groupBy("sample").agg(F.sum(term(F.col("p"), q)).alias("t"), F.sum(term(F.col("p") / 2, q)).alias("h"))
    halves = p.select("feature", "sample", (F.col("p") / 2).alias("half"), term(F.col("p") / 2, q).alias("part"))
    pairs = _shared(halves, "feature", F.sum(_beyond(q)), _beyond_arrays(q), tiled)
    rows = _with_spine(pairs, totals, spine)
    gamma = from_sum(F.col("h1") + F.col("h2") + F.coalesce("x", F.lit(0.0)), q)
    alpha = from_sum((F.col("t1") + F.col("t2")) / 2, q)
    beta = gamma / alpha
    return rows.select("s1", "s2", (dissimilarity(beta, q, 2.0, "naive", viewpoint) if dis else beta).alias("value"))


def phyl_beta(tab: DataFrame, tree: DataFrame, node_leaf: DataFrame, q: float = 1, dis: bool = True, viewpoint: str = "regional", use_values: bool = False, spine: DataFrame | None = None, tiled: bool = True) -> DataFrame:
    """s1, s2, value; sums of both levels are over the pair's pooled height.
    ``tiled``: nodes near the root, which all samples share, by tiles."""
    a = branch_shares(tab, node_leaf, use_values).join(tree.select("node", "branchL"), "node").where("a > 0")
    a = settled(a) if tiled else a
    length = F.col("branchL")
    totals = a.groupBy("sample").agg(F.sum(length * term(F.col("a"), q)).alias("t"), F.sum(length * term(F.col("a") / 2, q)).alias("h"), F.sum(length * F.col("a")).alias("m"))
    # Branches without length add nothing to any pair.
    halves = a.where("branchL <> 0").select("node", "sample", (F.col("a") / 2).alias("half"), term(F.col("a") / 2, q).alias("part"), "branchL")
    pairs = _shared(halves, "node", F.sum(F.col("branchL1") * _beyond(q)), _beyond_arrays(q, weighted=True), tiled)
    rows = _with_spine(pairs, totals, spine).withColumn("pooled", (F.col("m1") + F.col("m2")) / 2)
    gamma = from_sum(F.try_divide(F.col("h1") + F.col("h2") + F.coalesce("x", F.lit(0.0)), F.col("pooled")), q)
    alpha = from_sum(F.try_divide((F.col("t1") + F.col("t2")) / 2, F.col("pooled")), q)
    beta = gamma / alpha
    return rows.select("s1", "s2", (dissimilarity(beta, q, 2.0, "phyl", viewpoint) if dis else beta).alias("value"))


def func_beta(tab: DataFrame, distmat: DataFrame, q: float = 1, dis: bool = True, viewpoint: str = "regional", spine: DataFrame | None = None, tiled: bool = False) -> DataFrame:
    """s1, s2, value; the raw value is the square of the pair's ratio, null if
    no two of its features are apart.

    A pair's pooled weights are both samples' own but for shared features, so
    its quadratic form is theirs and a sum over the features they share, by what
    distances make of each sample alone. Only if q is not 1 do pairs of shared
    features meet. ``tiled``: for features that many samples share."""
    one = is_one(q)
    halves = relative(tab).select("feature", "sample", (F.col("p") / 2).alias("half"), term(F.col("p") / 2, q).alias("part"))
    plain, parts = halves.select("feature", "sample", F.col("half").alias("w")), halves.select("feature", "sample", F.col("part").alias("w"))
    both = plain if one else parts
    dx = by_distance(both, distmat, ["sample"]).select(F.col("f1").alias("feature"), "sample", F.col("dw").alias("dx"))
    rows = halves.join(dx, ["feature", "sample"], "left").withColumn("dx", F.coalesce("dx", F.lit(0.0)))
    rows = settled(rows) if tiled else rows
    beyond = _beyond_arrays(q)
    shared = _shared(rows, "feature", F.sum(_beyond(q) * (F.col("dx1") + F.col("dx2")) * 2), lambda a, b: 2 * beyond(a, b) * (a[2] + b[2]), tiled)
    if not one:
        a = halves.select("feature", F.col("sample").alias("s1"), F.col("half").alias("half1"), F.col("part").alias("part1"))
        b = halves.select("feature", F.col("sample").alias("s2"), F.col("half").alias("half2"), F.col("part").alias("part2"))
        e = a.join(b, "feature").where("s1 < s2").select("feature", "s1", "s2", _beyond(q).alias("w"))
        de = by_distance(e, distmat, ["s1", "s2"]).withColumnRenamed("f1", "feature")
        own = e.join(de, ["feature", "s1", "s2"]).select("s1", "s2", (F.col("w") * F.col("dw")).alias("x"))
        shared = shared.unionByName(own).groupBy("s1", "s2").agg(F.sum("x").alias("x"))
    rao = gram(plain, plain, distmat).withColumnRenamed("g", "rao")
    form = gram(parts, both, distmat)
    if one:  # ln(w_i w_j) is a sum: either feature's logarithm
        form = form.unionByName(form.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "g")).groupBy("s1", "s2").agg(F.sum("g").alias("g"))
    forms = rao.join(form, ["s1", "s2"], "full").select("s1", "s2", "rao", "g")
    pairs = (pair_spine(halves) if spine is None else spine).select("s1", "s2")
    each = forms.where("s1 = s2").select(F.col("s1").alias("sample"), "rao", "g")
    first, second = (each.select(F.col("sample").alias(f"s{k}"), F.col("rao").alias(f"rao{k}"), F.col("g").alias(f"g{k}")) for k in (1, 2))
    met = pairs.join(forms.where("s1 < s2"), ["s1", "s2"], "left").join(first, "s1", "left").join(second, "s2", "left").join(shared, ["s1", "s2"], "left")

    def pooled(name: str) -> Column:
        return F.coalesce(f"{name}1", F.lit(0.0)) + F.coalesce(f"{name}2", F.lit(0.0)) + F.coalesce(name, F.lit(0.0)) * 2

    met = met.select("s1", "s2", pooled("rao").alias("rao"), pooled("g").alias("total"), F.coalesce("x", F.lit(0.0)).alias("x"))
    gamma = from_sum(F.try_divide(F.col("total") + F.col("x"), F.col("rao")), q, 2.0)
    alpha = from_sum(F.try_divide(F.col("total"), F.col("rao")), q, 2.0) / 2
    beta = F.pow(F.try_divide(gamma, alpha), F.lit(2.0))
    return met.select("s1", "s2", (dissimilarity(beta, q, 2.0, "func", viewpoint) if dis else beta).alias("value"))


def bray(tab: DataFrame, use_values: bool = False, spine: DataFrame | None = None, tiled: bool = False, repeated: bool = False) -> DataFrame:
    if spine is None and not tiled and (found := pairwise.all_pairs(tab, pairwise.bray(), not use_values, repeated=repeated)) is not None:
        return found
    p = relative(_summed(tab, repeated), use_values)
    pairs = _shared(p, "feature", F.sum(F.least("p1", "p2")), lambda a, b: np.minimum(a[0], b[0]), tiled)
    return (pair_spine(p) if spine is None else spine).join(pairs, ["s1", "s2"], "left").select("s1", "s2", (F.lit(1.0) - F.coalesce("x", F.lit(0.0))).alias("value"))


def jaccard(tab: DataFrame, spine: DataFrame | None = None, repeated: bool = False) -> DataFrame:
    if spine is None and (found := pairwise.all_pairs(tab, pairwise.jaccard(), repeated=repeated)) is not None:
        return found
    p = _summed(tab, repeated).where("value > 0").select("feature", "sample")
    totals = p.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared_sums(p, "feature", F.count(F.lit(1)))
    both = F.coalesce("x", F.lit(0))
    return _with_spine(pairs, totals, spine).select("s1", "s2", (F.lit(1.0) - F.coalesce(F.try_divide(both, F.col("n1") + F.col("n2") - both), F.lit(0.0))).alias("value"))


# -- groups of samples ---------------------------------------------------------


def grouped(tab: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The table with each sample's group; samples without one are left out."""
    if groups is None:
        return tab.withColumn("grp", F.lit("all"))
    return tab.join(groups.where("grp is not null").select("sample", F.col("grp").cast("string").alias("grp")), "sample")


def _group_result(rows: DataFrame, q: float, div_type: str, size: str) -> DataFrame:
    n = F.col("n").cast("double")
    ok = F.col("n") >= 2
    return rows.select("grp", F.when(ok, n).alias(size), F.when(ok, F.col("beta")).alias("beta"), F.when(ok, dissimilarity(F.col("beta"), q, n, div_type, "local")).alias("local_dis"), F.when(ok, dissimilarity(F.col("beta"), q, n, div_type, "regional")).alias("regional_dis"))


def naive_multi_beta(tab: DataFrame, groups: DataFrame | None = None, q: float = 1) -> DataFrame:
    """grp, n, beta, local_dis, regional_dis; null for groups of one sample."""
    p = relative(tab)
    g = grouped(p, groups)
    n = g.groupBy("grp").agg(F.countDistinct("sample").alias("n"))
    pooled = g.groupBy("grp", "feature").agg(F.sum("p").alias("p")).join(n, "grp").groupBy("grp", "n").agg(from_sum(F.sum(term(F.col("p") / F.col("n"), q)), q).alias("gamma"))
    joint = g.join(n, "grp").groupBy("grp").agg(from_sum(F.sum(term(F.col("p") / F.col("n"), q)), q).alias("alpha"))
    rows = pooled.join(joint, "grp").select("grp", "n", (F.col("gamma") / (F.col("alpha") / F.col("n"))).alias("beta"))
    return _group_result(rows, q, "naive", "n")


def phyl_multi_beta(tab: DataFrame, tree: DataFrame, node_leaf: DataFrame, groups: DataFrame | None = None, q: float = 1) -> DataFrame:
    a = grouped(branch_shares(tab, node_leaf).join(tree.select("node", "branchL"), "node").where("a > 0"), groups)
    n = a.groupBy("grp").agg(F.countDistinct("sample").alias("n"))
    own = a.groupBy("grp").agg(F.sum(F.col("branchL") * term(F.col("a"), q)).alias("s"))
    mean = a.groupBy("grp", "node", "branchL").agg(F.sum("a").alias("a")).join(n, "grp").withColumn("a", F.col("a") / F.col("n"))
    pooled = mean.groupBy("grp", "n").agg(F.sum(F.col("branchL") * F.col("a")).alias("t"), F.sum(F.col("branchL") * term(F.col("a"), q)).alias("g"))
    gamma = from_sum(F.try_divide(F.col("g"), F.col("t")), q)
    alpha = from_sum(F.try_divide(F.col("s"), F.col("n") * F.col("t")), q)
    return _group_result(pooled.join(own, "grp").select("grp", "n", (gamma / alpha).alias("beta")), q, "phyl", "n")


def func_multi_beta(tab: DataFrame, distmat: DataFrame, groups: DataFrame | None = None, q: float = 1, squared: bool = False) -> DataFrame:
    """As ``naive_multi_beta``; the sum over all pairs of samples is one
    quadratic form of the group's summed weights."""
    g = grouped(relative(tab), groups)
    n = g.groupBy("grp").agg(F.countDistinct("sample").alias("n"))
    mean = g.groupBy("grp", "feature").agg(F.sum("p").alias("w")).join(n, "grp").withColumn("w", F.col("w") / F.col("n"))
    each = g.join(n, "grp").withColumn("w", F.col("p") / F.col("n"))

    def form(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        dw = by_distance(right, distmat, ["grp"]).withColumnRenamed("f1", "feature")
        return left.select("grp", "feature", "w").join(dw, ["grp", "feature"]).groupBy("grp").agg(F.sum(F.col("w") * F.col("dw")).alias(name))

    def summed(rows: DataFrame, w: Column) -> DataFrame:
        return rows.groupBy("grp", "feature").agg(F.sum(w).alias("w"))

    mean = mean.select("grp", "feature", "w")
    rao = form(mean, mean, "rao")
    w = F.col("w")
    if is_one(q):
        top = form(summed(mean, w * F.ln(w)), mean, "g").withColumn("g", F.col("g") * 2)
        low = form(summed(each, w * F.ln(w)), summed(each, w), "s").withColumn("s", F.col("s") * 2)
    else:
        top = form(summed(mean, F.pow(w, F.lit(float(q)))), summed(mean, F.pow(w, F.lit(float(q)))), "g")
        low = form(summed(each, F.pow(w, F.lit(float(q)))), summed(each, F.pow(w, F.lit(float(q)))), "s")
    gamma = from_sum(F.try_divide(F.col("g"), F.col("rao")), q, 2.0)
    alpha = from_sum(F.try_divide(F.col("s"), F.col("rao")), q, 2.0) / F.col("n")
    beta = F.try_divide(gamma, alpha)
    rows = n.join(rao, "grp", "left").join(top, "grp", "left").join(low, "grp", "left").select("grp", "n", (beta * beta if squared else beta).alias("beta"))
    return _group_result(rows, q, "func", "n")


def beta_profile(tab: DataFrame, groups: DataFrame | None = None, start: float = 0.0, stop: float = 2.0, step: float = 0.05) -> DataFrame:
    """q, grp, beta on an inclusive grid; groups of one sample are left out."""
    grid = [round(start + k * step, 10) for k in range(int(round((stop - start) / step)) + 1)]
    g = grouped(relative(tab), groups)
    n = g.groupBy("grp").agg(F.countDistinct("sample").alias("n")).where("n >= 2")
    joint = g.join(n, "grp").withColumn("x", F.col("p") / F.col("n"))
    pooled = joint.groupBy("grp", "n", "feature").agg(F.sum("x").alias("x"))
    low = joint.groupBy("grp").agg(*[from_sum(F.sum(term(F.col("x"), q)), q).alias(f"a{k}") for k, q in enumerate(grid)])
    top = pooled.groupBy("grp", "n").agg(*[from_sum(F.sum(term(F.col("x"), q)), q).alias(f"g{k}") for k, q in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), (F.col(f"g{k}") / F.col(f"a{k}") * F.col("n")).alias("beta")) for k, q in enumerate(grid)])
    return top.join(low, "grp").select("grp", F.inline(pairs)).select("q", "grp", "beta")


def dissimilarity_by_feature(tab: DataFrame, groups: DataFrame | None = None, q: float = 1, index: str = "regional", *, div_type: str = "naive", tree: DataFrame | None = None, node_leaf: DataFrame | None = None, branch_weight: str = "double") -> DataFrame:
    """grp, feature, pct and, on every row, the group's n and dis: what each
    feature (or node) adds to the dissimilarity among a group's samples.
    ``branch_weight`` 'double' weighs a node by its length twice."""
    local = index in ("local", "CR2")
    g = grouped(tab.where("value > 0"), groups)
    n = g.groupBy("grp").agg(F.countDistinct("sample").cast("double").alias("n"))
    if div_type == "phyl":
        a = grouped(branch_shares(tab, node_leaf), groups).join(tree.select(F.col("node"), "branchL"), "node").select("grp", F.col("node").alias("feature"), "sample", F.col("a").alias("value"), "branchL").where("value > 0")
    else:
        a = g.select("grp", "feature", "sample", F.col("value").cast("double").alias("value"), F.lit(1.0).alias("branchL"))
    v = F.col("value")
    power = F.sum(F.pow(v, F.lit(float(q)))) if local else F.pow(F.sum(v), F.lit(float(q)))
    if is_one(q):
        d = F.exp(F.ln(F.sum(v)) - F.sum(v * F.ln(v)) / F.sum(v))
    else:
        d = F.pow(F.sum(term(v, q)) / F.pow(F.sum(v), F.lit(float(q))), F.lit(1.0 / (1.0 - q)))
    rows = a.groupBy("grp", "feature", "branchL").agg(d.alias("d"), power.alias("z")).join(n.where("n >= 2"), "grp").withColumn("z", F.col("z") * F.col("branchL"))
    total = rows.groupBy("grp").agg(F.sum("z").alias("zs"))
    length = F.col("branchL") if branch_weight == "double" else F.lit(1.0)
    part = length * F.col("z") / F.col("zs") * (1 - evenness_column(F.col("d"), F.col("n"), q, "CR2" if local else "CR1"))
    rows = rows.join(total, "grp").select("grp", "n", "feature", part.alias("part"))
    dis = rows.groupBy("grp").agg(F.sum("part").alias("dis"))
    return rows.join(dis, "grp").select("grp", "feature", "n", "dis", (F.try_divide(F.col("part"), F.col("dis")) * 100).alias("pct"))


# -- relatedness between samples -------------------------------------------------


def mpd_between(w: DataFrame, distmat: DataFrame, spine: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, s1, s2, value from weights (keys, feature, sample, w)."""
    z = w.groupBy(*keys, "sample").agg(F.sum("w").alias("z"))
    g = gram(w, w, distmat, keys).where("s1 < s2")
    one, two = z.select(*keys, F.col("sample").alias("s1"), F.col("z").alias("z1")), z.select(*keys, F.col("sample").alias("s2"), F.col("z").alias("z2"))
    rows = spine.join(one, [*keys, "s1"]).join(two, [*keys, "s2"]).join(g, [*keys, "s1", "s2"], "left")
    return rows.select(*keys, "s1", "s2", F.try_divide(F.coalesce("g", F.lit(0.0)), F.col("z1") * F.col("z2")).alias("value"))


def mntd_between(w: DataFrame, distmat: DataFrame, spine: DataFrame, include_conspecifics: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, s1, s2, value from weights (keys, feature, sample, w). A feature
    without any other in the sample counts as distance 0."""
    z = w.groupBy(*keys, F.col("sample").alias("s1")).agg(F.sum("w").alias("z"))
    near = nearest(w, w, distmat, keys).where("s1 <> s2")
    if include_conspecifics:
        a = w.select(*keys, "feature", F.col("sample").alias("s1"), "w")
        own = a.join(w.select(*keys, "feature", F.col("sample").alias("s2")), [*keys, "feature"]).where("s1 <> s2").select(*keys, "s1", "s2", "feature", "w", F.lit(0.0).alias("near"))
        near = near.unionByName(own).groupBy(*keys, "s1", "s2", "feature", "w").agg(F.min("near").alias("near"))
    one = near.groupBy(*keys, "s1", "s2").agg(F.sum(F.col("w") * F.col("near")).alias("x"))
    one = one.join(z, [*keys, "s1"]).select(*keys, "s1", "s2", F.try_divide(F.col("x"), F.col("z")).alias("x"))
    both = one.select(*keys, F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), "x").groupBy(*keys, "s1", "s2").agg((F.sum("x") / 2).alias("x"))
    return spine.join(both, [*keys, "s1", "s2"], "left").select(*keys, "s1", "s2", F.coalesce("x", F.lit(0.0)).alias("value"))


def beta_mpd(tab: DataFrame, distmat: DataFrame, q: float = 1) -> DataFrame:
    """s1 < s2, value: mean distance between the features of two samples."""
    w = powers(tab, q)
    return mpd_between(w, distmat, pair_spine(w))


def beta_mntd(tab: DataFrame, distmat: DataFrame, q: float = 1, include_conspecifics: bool = False) -> DataFrame:
    """s1 < s2, value: mean of both directions' weighted nearest distances."""
    w = powers(tab, q)
    return mntd_between(w, distmat, pair_spine(w), include_conspecifics)


def to_square(pairs: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """Both triangles and the diagonal, one column a sample: for few samples."""
    s = pairs.select(F.explode(F.array("s1", "s2")).alias("s")).distinct()
    rows = pairs.select("s1", "s2", "value").unionByName(pairs.select(F.col("s2").alias("s1"), F.col("s1").alias("s2"), "value")).unionByName(s.select(F.col("s").alias("s1"), F.col("s").alias("s2"), F.lit(diagonal).alias("value")))
    return rows.groupBy("s1").pivot("s2").agg(F.first("value")).orderBy("s1")
