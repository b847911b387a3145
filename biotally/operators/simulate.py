"""Simulated communities, trees and assembly."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import normal, uniform
from ..sources.newick import Node, to_tables
from .relational import interval_hits


#: Rows that one dense matrix on the driver may have.
MOST_CELLS = 5_000_000


def simulate_community(spark: SparkSession, size: int = 100, communities: int = 1, sigma: float = 1.0, mean: float = 0.0, seed: int = 0, species: str = "SP", name: str = "C") -> DataFrame:
    """feature, sample, value: log-normal abundances, in percent of a community."""
    rows = spark.range(1, size + 1).select(F.concat(F.lit(species), F.col("id").cast("string")).alias("feature")).join(spark.range(1, communities + 1).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("sample")))
    x = F.exp(F.lit(float(mean)) + F.lit(float(sigma)) * normal(F.lit(seed), "sample", "feature"))
    rows = rows.withColumn("x", x)
    return rows.select("feature", "sample", (F.col("x") / F.sum("x").over(Window.partitionBy("sample")) * 100).alias("value"))


def community_sample(tab: DataFrame, n: int = 10_000, seed: int = 0) -> DataFrame:
    """feature, sample, value: n reads drawn from each community by abundance."""
    w = Window.partitionBy("sample")
    hi = F.sum("value").over(w.orderBy("feature"))
    cells = tab.where("value > 0").select("feature", "sample", (hi - F.col("value")).alias("lo"), F.sum("value").over(w).alias("total"))
    size = cells.groupBy("sample").agg(F.max("total").alias("total"))
    draws = size.select("sample", "total", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")).select("sample", (uniform(F.lit(seed), "sample", "i") * F.col("total")).alias("at"))
    return interval_hits(draws.withColumn("n", F.lit(1)), cells, ["sample"]).groupBy("feature", "sample").agg(F.sum("n").cast("double").alias("value"))


def _shares(selection: float, dispersal: float) -> tuple[float, float]:
    return selection / (selection + dispersal), dispersal / (selection + dispersal)


def assembly_steps(community: DataFrame, steps: int, selection: float = 1.0, dispersal: float = 1.0) -> DataFrame:
    """feature, sample, value after so many steps: ``community`` has feature,
    sample, value, immigrants and fitness. A step multiplies a value by its
    fitness and immigration, weighted, and scales to 100."""
    s, d = _shares(selection, dispersal)
    rate = F.col("fitness") * F.lit(s) + F.col("immigrants") * F.lit(d)
    # Scaling is one factor for a community, so all steps are one power.
    grown = community.withColumn("value", F.col("value") * F.pow(rate, F.lit(float(steps))))
    return grown.select("feature", "sample", (F.col("value") / F.sum("value").over(Window.partitionBy("sample")) * 100).alias("value"))


def simulate_assembly(community: DataFrame, *, selection: float = 1.0, dispersal: float = 1.0, max_iter: int = 1000, tol: float = 1e-6, noise: float = 0.0, interdependence: np.ndarray | None = None, seed: int = 0) -> tuple[DataFrame, int, bool]:
    """(feature, sample, value; steps; converged) until the squared changes sum
    to less than ``tol``. Convergence is of all communities together, so they
    are one dense matrix on the driver, with features in order of name.
    Interactions enter unscaled; negative values are cut only with noise. There
    may be ``MOST_CELLS`` rows at most; without interactions and noise
    ``assembly_steps`` has no bound."""
    pdf = community.limit(MOST_CELLS + 1).toPandas()
    if len(pdf) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} rows: too many for one dense matrix")
    wide = {c: pdf.pivot(index="feature", columns="sample", values=c).fillna(0.0).sort_index() for c in ("value", "immigrants", "fitness")}
    now = wide["value"].to_numpy(dtype=float)
    s, d = _shares(selection, dispersal)
    rate = 0.1 * (s * wide["fitness"].to_numpy(dtype=float) + d * wide["immigrants"].to_numpy(dtype=float))
    rng, done, step = np.random.default_rng(seed), False, 0
    for step in range(1, max_iter + 1):
        new = now * rate
        if interdependence is not None:
            new = new + interdependence @ now
        if noise > 0:
            new = np.maximum(0.0, new * (1 + noise * rng.standard_normal(new.shape)))
        new = 100 * new / new.sum(axis=0)
        done = bool(((new - now) ** 2).sum() < tol)
        now = new
        if done:
            break
    frame = wide["value"].copy()
    frame[:] = now
    long = frame.reset_index().melt(id_vars="feature", var_name="sample", value_name="value")
    return community.sparkSession.createDataFrame(long, "feature string, sample string, value double"), step, done


def interdependence_matrix(spark: SparkSession, n: int, strength: float = 0.1, positive: float = 0.5, symmetric: bool = False, diagonal: float = 0.0, seed: int = 0) -> DataFrame:
    """i, j, value: interactions between -strength and strength."""
    ids = spark.range(1, n + 1)
    rows = ids.select(F.col("id").alias("i")).join(ids.select(F.col("id").alias("j")))
    a, b = (F.least("i", "j"), F.greatest("i", "j")) if symmetric else (F.col("i"), F.col("j"))
    rows = rows.withColumn("a", a).withColumn("b", b)
    sign = F.when(uniform(F.lit(seed), F.lit("s"), "a", "b") < positive, 1.0).otherwise(-1.0)
    return rows.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(float(diagonal))).otherwise(uniform(F.lit(seed), F.lit("m"), "a", "b") * strength * sign).alias("value"))


def block_tree(spark: SparkSession, k_per_level: Sequence[int], branch_length: float | Sequence[float] | Callable[[int], float] = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, closure) of a balanced tree with so many children at each level;
    tips are SP1, SP2, ..."""
    root, level, tips = Node(name="root", length=0.0), [], 0
    level = [root]
    for k, children in enumerate(k_per_level):
        length = branch_length(k) if callable(branch_length) else branch_length[k] if isinstance(branch_length, Sequence) else branch_length
        below = []
        for parent in level:
            for _ in range(children):
                if k == len(k_per_level) - 1:
                    tips += 1
                    name = f"SP{tips}"
                else:
                    name = f"in{k + 1}_{len(below) + 1}"
                child = Node(name=name, length=float(length), parent=parent)
                parent.children.append(child)
                below.append(child)
        level = below
    return to_tables(spark, root)


def beta_splitting_tree(spark: SparkSession, n_leaves: int, beta: float = 0.0, branch_length: str | float | Sequence[float] | Callable[[int], float] = "ultrametric", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, closure) of a random tree: a clade of n splits into i and n - i
    with a probability of Aldous' beta model (-2 a comb, 0 Yule-like, large even)."""
    rng = np.random.default_rng(seed)
    count = [0, 0]

    def split(n: int) -> int:
        if beta <= -2:
            return 1
        i = np.arange(1, n)
        g = [math.lgamma(beta + k + 1) + math.lgamma(beta + n - k + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in i]
        p = np.exp(np.array(g) - max(g))
        return int(rng.choice(i, p=p / p.sum()))

    root = Node(name="root", length=0.0)
    stack = [(root, n_leaves, 0)]
    while stack:
        node, n, depth = stack.pop()
        if n == 1:
            count[0] += 1
            node.name = f"SP{count[0]}"
            continue
        if node is not root:
            count[1] += 1
            node.name = f"in{count[1]}"
        i = split(n)
        for m in (i, n - i):
            child = Node(parent=node)
            if branch_length != "ultrametric":
                child.length = float(branch_length(depth) if callable(branch_length) else branch_length[depth % len(branch_length)] if isinstance(branch_length, Sequence) else branch_length)
            node.children.append(child)
            stack.append((child, m, depth + 1))
    if branch_length == "ultrametric":  # a node's height is that of its clade's size
        height: dict[int, float] = {}
        for node in reversed(root.walk()):
            height[id(node)] = 0.0 if not node.children else max(height[id(c)] for c in node.children) + 1.0
        top = height[id(root)] or 1.0
        for node in root.walk():
            if node.parent is not None:
                node.length = (height[id(node.parent)] - height[id(node)]) / top
    return to_tables(spark, root)
