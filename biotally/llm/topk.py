"""Exact top-k inner products through a pivot-distance index.

One further component brings every indexed vector to the largest norm, and is 0
in a query; inner products then fall as distances grow. Vectors are
then keyed by their nearest pivot and the distance to it, and each pivot's
vectors are cut into annuli by distance: the blocks of the index, of which there
are ``MOST_BLOCKS`` at most, so that a table of their bounds is small. A query
first searches the block it lies in, then the ``PROMISING`` ones whose annuli
come nearest, which raises its score to beat; it then meets those of the others
alone that the triangle inequality lets hold such a score. Within a block search
expands outwards from the query's own distance and stops by the same bound.
Scores are computed in integers.

Equal vectors are one entry with its smallest ids (k + 1, with repeats, as a
query skips its own row), so a vector that a third of all rows share is neither
a hot block nor a hot query. Of a block and a query k + 1 rows are kept, ties by
id included. Queries meet blocks in cells of bounded size.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids, nor vectors so long that scores would not fit in 64
bits (a scaled norm of 2**31 and more); empty vectors are zero; shorter vectors
are padded with zeros; repeated ids and rows are rows like any other, as queries
and as candidates; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 64
K = 20
PIVOTS = 16
#: Distinct vectors that pivots are chosen from.
PIVOT_SAMPLE = 1024
#: Rows of a block, and of queries in one cell.
BLOCK = 4096
#: Blocks at most, above which they hold more rows.
MOST_BLOCKS = 65_536
#: Blocks that a query searches for a better score to beat, before all it may need.
PROMISING = 2


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    whole = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double").try_cast("long"))
    fine = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v))
    fits = F.aggregate(F.col(vector_col), F.lit(0.0), lambda a, v: a + F.pow(F.floor(v.cast("double") * F.lit(float(scale))).cast("double"), 2.0)) < F.lit(2.0**62)
    fine = fine & fits
    return vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _rows(values: pd.Series, dim: int) -> np.ndarray:
    if len(values) and all(len(v) == dim for v in values):
        return np.stack(values.to_list()).astype(np.int64)
    out = np.zeros((len(values), dim), dtype=np.int64)
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))]


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first over the sample."""
    if not len(sample):
        return sample
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(sq, 0.0))


def search_block(q: np.ndarray, qd: np.ndarray, beat: np.ndarray, v: np.ndarray, vd: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries q, at distances qd from a pivot, against entries v sorted by
    their distances vd from it -> (query, entry, score), with every entry that
    is among the k best. ``beat`` has a score for each query that k entries are
    known to reach; it is raised in place."""
    # Products of integers below 2**53 are exact in float64.
    exact = top < 2**50
    qn = (q.astype(np.float64) ** 2).sum(axis=1)
    qx, vx = (q.astype(np.float64), v.astype(np.float64)) if exact else (q, v)
    slack = 1e-6 * (1 + np.sqrt(top))  # more than rounding can put a distance off
    order = np.argsort(qd, kind="stable")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def window(some: np.ndarray) -> tuple[int, int]:
        """Entries whose distance from the pivot lets them reach the score to beat."""
        reach = np.sqrt(np.maximum(0.0, qn[some] + top - 2.0 * beat[some].astype(np.float64))) + slack
        return int(np.searchsorted(vd, float((qd[some] - reach).min()))), int(np.searchsorted(vd, float((qd[some] + reach).max()), side="right"))

    for at in range(0, len(order), 64):
        some = order[at : at + 64]
        bottom, roof = window(some)
        left = right = min(max(int(np.searchsorted(vd, float(np.median(qd[some])))), bottom), roof)
        best: list[np.ndarray] = []
        while left > bottom or right < roof:
            a, b = max(bottom, left - 512), min(roof, right + 512)
            ring = np.r_[min(a, left) : left, right : max(b, right)]
            left, right = min(a, left), max(b, right)
            s = qx[some] @ vx[ring].T
            s = np.rint(s).astype(np.int64) if exact else s
            x, y = np.nonzero(s >= beat[some][:, None])
            out.append((some[x], ring[y], s[x, y]))
            best = [np.concatenate([*best, s], axis=1)]
            if best[0].shape[1] >= k:
                best = [-np.partition(-best[0], k - 1, axis=1)[:, :k]]
                beat[some] = np.maximum(beat[some], best[0].min(axis=1))
                bottom, roof = window(some)
    if not out:
        return (np.array([], dtype=np.int64),) * 3
    x, y, s = (np.concatenate(c) for c in zip(*out, strict=True))
    keep = s >= beat[x]
    return x[keep], y[keep], s[keep]


LOWEST = -(2**62)
NO_HITS = {"entry": "str", "vec_id": "int64", "own": "bool", "score": "int64"}


def best_rows(entry: np.ndarray, ids: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of each query, by score and then by id."""
    order = np.lexsort((ids, -score, entry))
    entry, ids, own, score = entry[order], ids[order], own[order], score[order]
    first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]]) if len(entry) else np.array([], dtype=int)
    rank = np.arange(len(entry)) - np.repeat(first, np.diff(np.r_[first, len(entry)]))
    keep = rank < k
    return pd.DataFrame({"entry": entry[keep], "vec_id": ids[keep], "own": own[keep], "score": score[keep]})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` chooses queries by ``vec_id``."""
    rows = quantized(vectors, id_col, vector_col, scale)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    # k + 1 ids of an entry are all that any result can name.
    first = ranked.where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = cut(first.select("v", "ids", F.concat_ws(":", F.col("ids")[0].cast("string"), F.xxhash64("v").cast("string")).alias("entry")))
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).first()
    n, dim, top = facts["n"], max(1, facts["dim"] or 1), float(facts["top"] or 0.0)
    sample = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(PIVOT_SAMPLE).toPandas()
    centres = choose_pivots(lifted(_rows(sample["v"], dim), top), pivots)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(lifted(_rows(pdf["v"], dim), top), centres)
                near = d.argmin(axis=1)
                yield pdf.assign(pivot=near.astype(np.int32), dist=d[np.arange(len(d)), near])

    index = entries.mapInPandas(keyed, "v array<long>, ids array<long>, entry string, pivot int, dist double")
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK)))
    index = cut(index.repartitionByRange(blocks, "pivot", "dist", "entry").withColumn("block", F.spark_partition_id()))
    # A row for each block and pivot in it; blocks are ranges of (pivot, dist).
    bounds = index.groupBy("block", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("block", "pivot").toPandas()
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = cut(asked.join(entries.select("v", "entry"), "v").select("query_id", "entry", "copies"))
    queries = cut(index.join(asked.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("entry"), F.col("v").alias("v"), F.col("block").alias("home"), F.lit(LOWEST).cast("long").alias("beat")))

    def searched(q: pd.DataFrame, e: pd.DataFrame, beat: np.ndarray):
        """Over the pivots of a block -> rows of q, rows of e, scores."""
        qv, found = _rows(q["v"], dim), []
        qd = distances(np.c_[qv.astype(np.float64), np.zeros(len(qv))], centres)
        for p, own in e.groupby("pivot"):
            own = own.sort_values("dist")
            x, y, s = search_block(qv, qd[:, int(p)], beat, _rows(own["v"], dim), own["dist"].to_numpy(), top, k + 1)
            found.append((x, own.index.to_numpy()[y], s))
        return (np.concatenate(c) for c in zip(*found, strict=True))

    def in_cell(key: tuple, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in NO_HITS.items()})
        x, y, s = searched(q, e, q["beat"].to_numpy().copy())
        ids = e["ids"].to_numpy()[y]
        many = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        own = q["entry"].to_numpy()[x] == e["entry"].to_numpy()[y]
        best = best_rows(np.repeat(x, many), np.concatenate(ids) if len(ids) else np.array([], dtype=np.int64), np.repeat(own, many), np.repeat(s, many), k + 1)
        return best.assign(entry=q["entry"].to_numpy()[best["entry"].to_numpy(dtype=np.int64)])

    def met(q: DataFrame) -> DataFrame:
        """Hits (entry, vec_id, own, score) of queries (entry, v, beat, block)."""
        # A row for each block.
        cells = q.groupBy(F.col("block").alias("block")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cells"))
        q = q.join(F.broadcast(cells), "block").withColumn("cell", F.pmod(F.xxhash64("entry"), F.col("cells")).cast("int"))
        e = index.join(F.broadcast(cells), "block").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        pairs = q.select("cell", "block", "entry", "v", "beat").groupBy("cell", "block").cogroup(e.select("cell", "block", "entry", "v", "ids", "pivot", "dist").groupBy("cell", "block"))
        return cut(pairs.applyInPandas(in_cell, "entry string, vec_id long, own boolean, score long"))

    def raised(hits: DataFrame) -> DataFrame:
        """The queries with the scores that k + 1 of their hits reach."""
        nth = hits.withColumn("n", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("score")))).where(F.col("n") == k + 1).select("entry", F.col("score").alias("new"))
        return queries.join(nth, "entry", "left").withColumn("beat", F.greatest("beat", "new")).drop("new")

    def reaching(q: DataFrame, begin: int, end: int | None) -> DataFrame:
        """(entry, v, beat, block): of the blocks beside home that may hold a
        score to beat, those of rank begin to end by promise."""
        block, pivot, lo, hi = (bounds[c].to_numpy() for c in ("block", "pivot", "lo", "hi"))
        number, of = np.unique(block, return_inverse=True)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.array([], dtype=int)
        step = max(1, 4_000_000 // max(1, len(block)))
        slack = 1e-6 * (1 + np.sqrt(top))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for at in range(0, len(whole), step):
                    pdf = whole.iloc[at : at + step]
                    v = _rows(pdf["v"], dim).astype(np.float64)
                    d = distances(np.c_[v, np.zeros(len(v))], centres)[:, pivot]
                    gap = np.minimum.reduceat(np.maximum(0.0, np.maximum(lo - d, d - hi)), starts, axis=1)
                    reach = np.sqrt(np.maximum(0.0, (v * v).sum(axis=1) + top - 2.0 * pdf["beat"].to_numpy(dtype=np.float64))) + slack
                    gap[number[None, :] == pdf["home"].to_numpy()[:, None]] = np.inf
                    order = np.argsort(gap, axis=1, kind="stable")
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(len(number))[None, :], axis=1)
                    x, y = np.nonzero((gap <= reach[:, None]) & (rank >= begin) & (rank < (len(number) if end is None else end)))
                    yield pd.DataFrame({"entry": pdf["entry"].to_numpy()[x], "v": pdf["v"].to_numpy()[x], "beat": pdf["beat"].to_numpy()[x], "block": number[y].astype(np.int32)})

        return q.select("entry", "v", "home", "beat").mapInPandas(run, "entry string, v array<long>, beat long, block int")

    hits = met(queries.withColumnRenamed("home", "block"))
    if len(bounds) and bounds["block"].nunique() > 1:
        hits = hits.unionByName(met(reaching(raised(hits), 0, PROMISING)))
        hits = hits.unionByName(met(reaching(cut(raised(hits)), PROMISING, None)))
    order = (F.desc("score"), F.asc("vec_id"))
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("entry").orderBy(*order))).where(F.col("n") <= k + 1)
    out = asked.join(best.drop("n"), "entry")
    # A query's own row is one of those of its id in its own entry.
    mine = F.col("own") & (F.col("vec_id") == F.col("query_id"))
    nth = F.row_number().over(Window.partitionBy("query_id", "entry", "own", "vec_id").orderBy("score"))
    out = out.withColumn("nth", nth).where(~(mine & (F.col("nth") == 1)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "entry").orderBy(*order))).where(F.col("rank") <= k)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")
