"""Null models: an iteration is a column, and iteration 0 is what was observed.

Randomisation is by hashes of (seed, iteration, sample, feature), so a result
does not depend on partitions or on how often it is computed. Every iteration's
table is a set of rows and all iterations go through one plan. With ``arrays``
the same iterations are run in tasks and only their moments leave these
(``moments``), for many iterations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import exponential, key
from . import beta, drawn, moments, pairwise
from .alpha import nearest, powers
from .relational import settled

SEPARATOR = "\u0001"


def iterations(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(1, n + 1).select(F.col("id").alias("it"))


def against_null(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(it, keys, value), it 0 observed -> keys, obs, null_mean, null_std, p,
    ses. Null as soon as the observed value or any iteration's is."""
    obs = values.where("it = 0").select(*keys, F.col(value).alias("obs"))
    x, o = F.round(F.col(value), 10), F.round("obs", 10)
    n, known = F.count(F.lit(1)), F.count(value)
    rows = values.where("it > 0").join(obs, keys).groupBy(*keys, "obs")
    out = rows.agg(F.when(n == known, F.avg(value)).alias("null_mean"), F.when(n == known, F.stddev_samp(value)).alias("null_std"), F.when(F.first("obs").isNotNull(), (F.sum(F.when(x < o, 1.0).otherwise(0.0)) + 0.5 * F.sum(F.when(x == o, 1.0).otherwise(0.0))) / n).alias("p"))
    ses = F.when(F.round("null_std", 10) > 0, (F.col("null_mean") - F.col("obs")) / F.col("null_std"))
    return out.select(*keys, "obs", "null_mean", "null_std", "p", ses.alias("ses"))


def permuted(w: DataFrame, n: int, seed: int, randomization: str = "features") -> DataFrame:
    """it, feature, sample, w with features permuted for all samples alike
    ('features') or within each sample ('abundances'); it 0 as given."""
    if randomization not in ("features", "abundances"):
        raise ValueError("randomization is features or abundances")
    within = ["it"] if randomization == "features" else ["it", "sample"]
    all_ = w.select("feature").distinct().join(iterations(w, n))  # every feature in every iteration
    if randomization == "abundances":
        all_ = all_.join(w.select("sample").distinct())
    place = F.row_number().over(Window.partitionBy(*within).orderBy("feature"))
    drawn = F.row_number().over(Window.partitionBy(*within).orderBy(key(F.lit(seed), *within, "feature"), "feature"))
    ranks = all_.withColumn("place", place).withColumn("drawn", drawn)
    moves = ranks.select(*within, "feature", "place").join(ranks.select(*within, F.col("feature").alias("to"), F.col("drawn").alias("place")), [*within, "place"])
    on = ["feature"] if randomization == "features" else ["feature", "sample"]
    null = w.join(moves.drop("place"), on).select("it", F.col("to").alias("feature"), "sample", "w")
    return w.select(F.lit(0).cast("long").alias("it"), "feature", "sample", "w").unionByName(null)


def nri(tab: DataFrame, distmat: DataFrame, q: float = 1, n: int = 999, randomization: str = "features", seed: int = 0, arrays: bool = False) -> DataFrame:
    """sample, obs, null_mean, null_std, p, ses of the mean pairwise distance."""
    if arrays:
        return moments.against_null(powers(tab, q), distmat, moments.mean_pairwise, n, seed, randomization, own=True)
    w = permuted(powers(tab, q), n, seed, randomization)
    dw = w.join(distmat, w["feature"] == distmat["f2"]).groupBy("it", "sample", F.col("f1").alias("feature")).agg(F.sum(F.col("d") * F.col("w")).alias("dw"))
    g = w.join(dw, ["it", "sample", "feature"]).groupBy("it", "sample").agg(F.sum(F.col("w") * F.col("dw")).alias("g"))
    size = w.groupBy("it", "sample").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("w")).alias("z2"), F.count(F.lit(1)).alias("k"))
    value = F.when(F.col("k") >= 2, F.try_divide(F.coalesce("g", F.lit(0.0)), F.col("z") * F.col("z") - F.col("z2")))
    return against_null(size.join(g, ["it", "sample"], "left").select("it", "sample", value.alias("value")), ["sample"])


def nti(tab: DataFrame, distmat: DataFrame, q: float = 1, n: int = 999, randomization: str = "features", seed: int = 0, arrays: bool = False) -> DataFrame:
    """sample, obs, null_mean, null_std, p, ses of the mean nearest-taxon distance."""
    if arrays:
        return moments.against_null(powers(tab, q), distmat, moments.mean_nearest, n, seed, randomization, own=True)
    w = permuted(powers(tab, q), n, seed, randomization)
    near = nearest(w, w, distmat, ("it",)).where("s1 = s2")
    out = near.groupBy("it", F.col("s1").alias("sample")).agg((F.sum(F.col("w") * F.col("near")) / F.sum("w")).alias("value"))
    return against_null(w.select("it", "sample").distinct().join(out, ["it", "sample"], "left"), ["sample"])


def _spine(w: DataFrame, n: int) -> DataFrame:
    return beta.pair_spine(w).join(w.sparkSession.range(n + 1).select(F.col("id").alias("it")))


def beta_nri(tab: DataFrame, distmat: DataFrame, q: float = 1, n: int = 999, randomization: str = "features", seed: int = 0, arrays: bool = False) -> DataFrame:
    """s1, s2, obs, null_mean, null_std, p, ses."""
    if arrays:
        return moments.against_null(powers(tab, q), distmat, moments.between_pairwise, n, seed, randomization, own=False)
    w = powers(tab, q)
    return against_null(beta.mpd_between(permuted(w, n, seed, randomization), distmat, _spine(w, n), ("it",)), ["s1", "s2"])


def beta_nti(tab: DataFrame, distmat: DataFrame, q: float = 1, n: int = 999, randomization: str = "features", include_conspecifics: bool = False, seed: int = 0, arrays: bool = False) -> DataFrame:
    """s1, s2, obs, null_mean, null_std, p, ses."""
    if arrays:
        return moments.against_null(powers(tab, q), distmat, moments.between_nearest, n, seed, randomization, own=False, conspecifics=include_conspecifics)
    w = powers(tab, q)
    return against_null(beta.mntd_between(permuted(w, n, seed, randomization), distmat, _spine(w, n), include_conspecifics, ("it",)), ["s1", "s2"])


def _whole_counts(tab: DataFrame, groups: DataFrame | None) -> DataFrame:
    """feature, sample, value, grp; raises for counts that are not whole and for
    samples without a group."""
    rows = tab.where("value > 0").withColumn("value", F.when(F.col("value") == F.floor("value"), F.col("value").cast("long")).otherwise(F.raise_error(F.lit("counts must be whole")).cast("long")))
    if groups is None:
        rows = rows.withColumn("grp", F.lit("all"))
    else:
        g = F.when(F.col("grp").isNull(), F.raise_error(F.lit("a sample has no group")).cast("string")).otherwise(F.col("grp").cast("string"))
        rows = rows.join(groups.select("sample", "grp"), "sample", "left").withColumn("grp", g)
    return rows


def _pool(rows: DataFrame) -> DataFrame:
    """grp, feature, abundance, frequency."""
    return rows.groupBy("grp", "feature").agg(F.sum("value").alias("abundance"), F.count(F.lit(1)).alias("frequency"))


#: How many roots of a sample's richness more keys than it are kept.
MARGIN = 8.0
#: Copies of a group's pool, each for a share of the samples and iterations.
COPIES = 32
#: Draws of a task's row.
DRAWS = 1 << 16


def _tasks(tab: DataFrame) -> int:
    return int(tab.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _chosen(each: DataFrame, pool: DataFrame, weight: Column, seed: int) -> DataFrame:
    """it, sample, feature, richness, reads, abundance, found: of each (grp,
    sample, it) the features of the least keys, and how many keys are within its
    bound (all, if null). Keys beyond it are not shuffled."""
    tasks = 4 * _tasks(each)
    ours = each.withColumn("copy", F.pmod(F.xxhash64("it", "sample"), F.lit(COPIES))).repartition(tasks, "grp", "copy")
    theirs = pool.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))).repartition(tasks, "grp", "copy")
    draws = ours.join(theirs, ["grp", "copy"]).withColumn("k", exponential(weight, F.lit(seed), "it", "sample", "feature")).where("bound is null or k <= bound")
    w = Window.partitionBy("it", "sample")
    ranked = draws.select("it", "sample", "feature", "richness", "reads", "abundance", F.row_number().over(w.orderBy("k", "feature")).alias("n"), F.count(F.lit(1)).over(w).alias("found"))
    return ranked.where("n <= richness").drop("n")


def _more(seed: int):
    """(it, sample, cells, more, chunk) -> it, sample, feature, n: a chunk of a
    sample's further reads, each in the interval of a feature's abundance that a
    number by its md5 key falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                it, sample, more, chunk = (batch.column(c)[r].as_py() for c in ("it", "sample", "more", "chunk"))
                cells = batch.column("cells")[r].values
                hi = np.cumsum(cells.field("abundance").to_numpy())
                base, raw = hashlib.md5(f"{seed}:{it}:{sample}:read:".encode()), bytearray()
                for i in range(chunk * DRAWS + 1, min(more, (chunk + 1) * DRAWS) + 1):
                    h = base.copy()
                    h.update(b"%d" % i)
                    raw += h.digest()
                bits = np.frombuffer(bytes(raw), dtype=">u8").reshape(-1, 2)[:, 0].astype(np.uint64) >> np.uint64(16)
                at = np.floor((bits.astype(float) + 0.5) / 281474976710656.0 * float(hi[-1])).astype(np.int64)
                counts = np.bincount(np.searchsorted(hi, at, side="right"), minlength=len(hi))
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), it, dtype=np.int64)), pa.array([sample] * len(hit), pa.string()), cells.field("feature").take(pa.array(hit)), pa.array(counts[hit])], names=["it", "sample", "feature", "n"])

    return run


def random_tables(tab: DataFrame, n: int, seed: int, groups: DataFrame | None = None, randomization: str = "frequency") -> DataFrame:
    """it, feature, sample, value: each sample keeps its richness and reads.
    Features are drawn without replacement by how often (or how abundantly)
    their group has them; each gets a read, and the rest go by abundance."""
    if randomization not in ("frequency", "abundance"):
        raise ValueError("randomization is frequency or abundance")
    rows = _whole_counts(tab, groups)
    pool = _pool(rows)
    size = rows.groupBy("grp", "sample").agg(F.count(F.lit(1)).alias("richness"), F.sum("value").alias("reads"))
    weight = F.col("frequency" if randomization == "frequency" else "abundance").cast("double")
    # Keys up to ``bound`` are enough but for a chance of nothing: the expected
    # number of a group's keys up to t is at least t sum(w) - t^2 sum(w^2) / 2.
    sums = pool.groupBy("grp").agg(F.sum(weight).alias("w1"), F.sum(weight * weight).alias("w2"))
    root = F.col("w1") * F.col("w1") - F.col("w2") * 2 * (F.col("richness") + MARGIN * (F.sqrt("richness") + 5))
    bound = F.when(root > 0, (F.col("w1") - F.sqrt(root)) / F.col("w2"))
    each = settled(size.join(sums, "grp").select("grp", "sample", "richness", "reads", bound.alias("bound")).join(iterations(tab, n)))
    chosen = settled(_chosen(each, pool, weight, seed).where("found >= richness"))
    short = each.join(chosen.select("it", "sample").distinct(), ["it", "sample"], "left_anti")
    if not short.isEmpty():  # those are drawn from all keys
        chosen = settled(chosen.unionByName(_chosen(short.withColumn("bound", F.lit(None).cast("double")), pool, weight, seed)))
    cells = chosen.groupBy("it", "sample").agg(F.sort_array(F.collect_list(F.struct("feature", "abundance"))).alias("cells"), (F.first("reads") - F.first("richness")).alias("more")).where("more > 0")
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(more - 1) div {DRAWS}")))
    extra = cells.withColumn("chunk", chunk).repartition(4 * _tasks(tab), "it", "sample", "chunk").mapInArrow(_more(seed), "it long, sample string, feature string, n long")
    both = chosen.select("it", "sample", "feature", F.lit(1).cast("long").alias("n")).unionByName(extra)
    return both.groupBy("it", "feature", "sample").agg(F.sum("n").cast("double").alias("value"))


def rcq(tab: DataFrame, div_type: str = "naive", q: float = 1, n: int = 999, groups: DataFrame | None = None, randomization: str = "frequency", seed: int = 0, tree: DataFrame | None = None, node_leaf: DataFrame | None = None, distmat: DataFrame | None = None, arrays: bool = False) -> DataFrame:
    """s1, s2, obs, null_mean, null_std, p, ses of a dissimilarity. ``arrays``:
    tables are drawn and compared in tasks (``drawn``); Bray, Jaccard, naive."""
    if arrays:
        kinds = {"bray": drawn.bray, "jaccard": drawn.jaccard, "naive": drawn.naive(q)}
        if div_type.lower() not in kinds:
            raise ValueError("arrays are for Bray, Jaccard and naive")
        if randomization not in ("frequency", "abundance"):
            raise ValueError("randomization is frequency or abundance")
        rows = settled(_whole_counts(tab.where("feature is not null and sample is not null"), groups))
        pool = _pool(rows).select("grp", "feature", "abundance", F.col(randomization).alias("weight"))
        return drawn.against_null(rows, pool, kinds[div_type.lower()], n, seed)
    # Many joins below read the tables of all iterations; they are drawn once.
    null = settled(random_tables(tab, n, seed, groups, randomization))
    rows = tab.where("value > 0").select(F.lit(0).cast("long").alias("it"), "feature", "sample", F.col("value").cast("double").alias("value")).unionByName(null)

    def keyed(name: Column | str) -> Column:
        return F.concat(F.col("it").cast("string"), F.lit(SEPARATOR), name)

    # Ids that hold the iteration keep iterations apart in every join below.
    table = rows.select(keyed("feature").alias("feature"), keyed("sample").alias("sample"), "value")
    spine = _spine(tab, n).select(keyed("s1").alias("s1"), keyed("s2").alias("s2"))
    every = tab.sparkSession.range(n + 1).select(F.col("id").alias("it"))
    kind = div_type.lower()
    measures = {"bray": pairwise.bray(), "jaccard": pairwise.jaccard(), "naive": pairwise.regional(q)}
    if kind in measures and (found := pairwise.all_pairs(rows, measures[kind], its=n)) is not None:
        return found
    if kind == "bray":
        values = beta.bray(table, spine=spine)
    elif kind == "jaccard":
        values = beta.jaccard(table, spine=spine)
    elif kind == "naive":
        values = beta.naive_beta(table, q, spine=spine)
    elif kind == "phyl":
        nodes = tree.join(every).select(keyed("node").alias("node"), "branchL")
        leaves = node_leaf.join(every).select(keyed("node").alias("node"), keyed("leaf").alias("leaf"))
        values = beta.phyl_beta(table, nodes, leaves, q, spine=spine)
    elif kind == "func":
        values = beta.func_beta(table, distmat.join(every).select(keyed("f1").alias("f1"), keyed("f2").alias("f2"), "d"), q, spine=spine)
    else:
        raise ValueError("div_type is Bray, Jaccard, naive, phyl or func")
    it = F.split("s1", SEPARATOR)[0].cast("long")
    values = values.select(it.alias("it"), F.split("s1", SEPARATOR)[1].alias("s1"), F.split("s2", SEPARATOR)[1].alias("s2"), "value")
    return against_null(values, ["s1", "s2"])


def null_from(build: Callable[[DataFrame], DataFrame], w: DataFrame, keys: list[str], n: int, seed: int = 0, randomization: str = "features") -> DataFrame:
    """A null model of any statistic: ``build`` maps (it, feature, sample, w) to
    (it, keys, value)."""
    return against_null(build(permuted(w, n, seed, randomization)), keys)
