"""Raup-Crick null models in tasks: tables are drawn as arrays.

A task gets two blocks of samples, the pools of their groups and a span of
iterations. For each it draws both blocks' tables, takes the dissimilarities
and keeps moments only (``moments``): no row for an iteration, sample and feature
of the pool, and none for a read, which ``nulls.random_tables`` makes.

Features are drawn without replacement by exponential keys and the reads beyond
one each by a multinomial number, from a generator that (seed, iteration,
sample) starts, so a table does not depend on blocks, spans or partitions. These
are other draws than those by md5 keys, of the same distribution.

Defined cases: as ``nulls.random_tables``; rows without a feature or sample take
no part; a table without positive counts gives no rows. Pools of up to
``MOST_POOLED`` rows of (group, feature) are sent to every task. Larger ones are
put in bins of about so many rows, of whole groups: each block of samples is of
one bin and meets its pools once, when all its tables are drawn, which are then
kept (``_binned``); a task holds a bin, of one group at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hill import is_one
from . import pairwise
from .moments import MOMENTS, PAIRS, PART, part_row, summaries, summed
from .relational import numbered, running, settled

#: Rows of pools that are sent to every task, and of a bin otherwise, about.
MOST_POOLED = 1 << 20
#: Cells of a block's tables that are kept together, about.
STORED = 1 << 21
#: Iterations whose moments leave a task together.
CHUNK = 64
#: Samples of a block, at most.
SAMPLES = 512

Pools = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Dissimilarities (samples x samples) of two tables (features x samples).
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _draw_one(rich: int, reads: int, pool: tuple[np.ndarray, np.ndarray, np.ndarray], name: str, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a sample's table. Drawing by weight and leaving out
    what was drawn before is the order of exponential keys; it takes a look at
    each draw instead of each feature of the pool. ``ends``: its weights' running
    sums, if they are at hand."""
    codes, abundance, weight = pool
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.md5(name.encode()).digest(), "big")))
    if rich * 4 > len(codes):
        chosen = np.argpartition(rng.standard_exponential(len(codes)) / weight, rich - 1)[:rich]
    else:
        ends, chosen = np.cumsum(weight) if ends is None else ends, np.empty(0, dtype=np.int64)
        while len(chosen) < rich:
            more = np.searchsorted(ends, rng.random(rich - len(chosen) + 8) * ends[-1], side="right")
            found, first = np.unique(np.concatenate([chosen, more]), return_index=True)
            chosen = found[np.argsort(first)][:rich]
    chosen = np.sort(chosen)
    share = abundance[chosen]
    return codes[chosen], 1 + rng.multinomial(reads - rich, share / share.sum())


def draw(counts: np.ndarray, samples: list[str], groups: list[str], pools: Pools, seed: int, it: int) -> np.ndarray:
    """A table with each sample's richness and reads."""
    out = np.zeros_like(counts)
    for s, (sample, group) in enumerate(zip(samples, groups, strict=True)):
        codes, n = _draw_one(int((counts[:, s] > 0).sum()), int(counts[:, s].sum()), pools[group], f"{seed}:{it}:{sample}")
        out[codes, s] = n
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (a > 0).astype(float), (b > 0).astype(float)
    both = a.T @ b
    return 1 - both / (a.sum(axis=0)[:, None] + b.sum(axis=0)[None] - both)


def _over_features(a: list[np.ndarray], b: list[np.ndarray], value: Callable[..., np.ndarray]) -> np.ndarray:
    """Sums of ``value`` over the features of each of a's samples."""
    out = np.empty((a[0].shape[1], b[0].shape[1]))
    for s in range(len(out)):
        own = np.flatnonzero(a[0][:, s])
        out[s] = value([x[own, s][:, None] for x in a], [x[own] for x in b]).sum(axis=0)
    return out


def bray(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - _over_features([a / a.sum(axis=0)], [b / b.sum(axis=0)], lambda x, y: np.minimum(x[0], y[0]))


#: The same on sparse tables, for tasks.
bray.measure, jaccard.measure = pairwise.bray(), pairwise.jaccard()


def naive(q: float) -> Distance:
    """The regional dissimilarity of Hill numbers of order q."""

    def terms(x: np.ndarray) -> np.ndarray:
        at = np.where(x > 0, x, 1.0)
        return np.where(x > 0, at * np.log(at) if is_one(q) else at**q, 0.0)

    def number(total: np.ndarray) -> np.ndarray:
        return np.exp(-total) if is_one(q) else total ** (1 / (1 - q))

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = [x / x.sum(axis=0) for x in (a, b)]
        half = [x / 2 for x in p]
        part = [terms(x) for x in half]
        whole, own = [terms(x).sum(axis=0) for x in p], [x.sum(axis=0) for x in part]
        shared = _over_features([half[0], part[0]], [half[1], part[1]], lambda x, y: terms(x[0] + y[0]) - x[1] - y[1])
        beta = number(own[0][:, None] + own[1][None] + shared) / number((whole[0][:, None] + whole[1][None]) / 2)
        if is_one(q):
            return np.log(beta) / np.log(2)
        low = 2.0 ** (q - 1)
        return 1 - (beta ** (q - 1) - low) / (1 - low)

    distance.measure = pairwise.regional(q)
    return distance


def _block(rows: pa.StructArray) -> tuple[list[str], list[str], pairwise.Side]:
    """Samples by name, their groups, and their counts."""
    code, sample, value, grp = (rows.field(k) for k in range(4))
    names = sample.dictionary_encode()
    samples = names.dictionary.to_pylist()
    order = sorted(range(len(samples)), key=samples.__getitem__)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    at = place[names.indices.to_numpy()]
    first = np.unique(at, return_index=True)[1]
    return [samples[k] for k in order], grp.take(pa.array(first)).to_pylist(), pairwise.Side(at, code.to_numpy(), value.to_numpy(), np.ones(len(at), dtype=bool))


def _redrawn(side: pairwise.Side, samples: list[str], groups: list[str], pools: Pools, seed: int, it: int, ends: dict[str, np.ndarray]) -> pairwise.Side:
    rich = np.bincount(side.sample, minlength=len(samples))
    reads = np.bincount(side.sample, side.value, minlength=len(samples)).astype(np.int64)
    each = [_draw_one(int(rich[s]), int(reads[s]), pools[groups[s]], f"{seed}:{it}:{samples[s]}", ends[groups[s]]) for s in range(len(samples))]
    return pairwise.Side(np.repeat(np.arange(len(samples)), rich), np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each]).astype(float), np.ones(rich.sum(), dtype=bool))


def _spans(measure: pairwise.Measure, seed: int, n: int, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                a, b = row["a"].as_py(), row["b"].as_py()
                group, *numbers = (row["pool"].values.field(k) for k in range(4))
                code, abundance, weight = (x.to_numpy() for x in numbers)
                names = np.array(group.to_pylist(), dtype=object)
                pools = {g: (code[at], abundance[at], weight[at]) for g in set(names) for at in [np.flatnonzero(names == g)]}
                ends = {g: np.cumsum(x[2]) for g, x in pools.items()}
                one, of_one, x = _block(row["one"].values)
                two, of_two, y = (one, of_one, x) if a == b else _block(row["two"].values)
                compared = lambda u, v: pairwise._compared(measure, True, u, v, (len(one), len(two)), features)  # noqa: B023, E731
                observed = compared(x, y)
                for chunk in range(row["begin"].as_py(), row["end"].as_py()):
                    each = [observed]
                    for it in range(chunk * CHUNK + 1, min(n, (chunk + 1) * CHUNK) + 1):
                        u = _redrawn(x, one, of_one, pools, seed, it, ends)
                        each.append(compared(u, u if a == b else _redrawn(y, two, of_two, pools, seed, it, ends)))
                    m = summed(np.stack(each).reshape(len(each), -1))
                    yield part_row(a, b, chunk, 0, one, two, np.stack([m[k] for k in MOMENTS]))

    return run


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _pack_pool(table: pa.Table) -> pa.Table:
    """A bin's pools as one row, by group and code."""
    data = _stream(table.select(["grp", "code", "abundance", "weight"]).sort_by([("grp", "ascending"), ("code", "ascending")]))
    return pa.table({"bin": table["bin"].slice(0, 1), "pools": pa.array([data], pa.binary())})


def _pack_block(table: pa.Table) -> pa.Table:
    """A block as one row: its samples by name, and its cells."""
    samples, groups, side = _block(table.select(["code", "sample", "value", "grp"]).to_struct_array().combine_chunks())
    names = _stream(pa.table({"name": pa.array(samples, pa.string()), "grp": pa.array(groups, pa.string())}))
    cells = _stream(pa.table({"sample": side.sample.astype(np.int32), "feature": side.code, "value": side.value}))
    return pa.table({"block": table["block"].slice(0, 1), "bin": table["bin"].slice(0, 1), "names": pa.array([names], pa.binary()), "cells": pa.array([cells], pa.binary())})


def _all_drawn(n: int, seed: int):
    """A block's observed table and the ``n`` drawn ones, as ``pairwise`` packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                names, cells, pool = (_read(batch.column(c)[r]) for c in ("names", "cells", "pools"))
                samples, groups = names["name"].to_pylist(), names["grp"].to_pylist()
                of = pool["grp"].combine_chunks().dictionary_encode()
                cut = np.append(np.unique(of.indices.to_numpy(), return_index=True)[1], len(of))
                numbers = [pool[c].to_numpy() for c in ("code", "abundance", "weight")]
                wanted = set(groups)
                pools = {g: tuple(x[cut[k] : cut[k + 1]] for x in numbers) for k, g in enumerate(of.dictionary.to_pylist()) if g in wanted}
                ends = {g: np.cumsum(x[2]) for g, x in pools.items()}
                first = pairwise.Side(*[cells[c].to_numpy() for c in ("sample", "feature", "value")], None)
                # By feature, as they meet.
                tables = [pairwise.Side(*[c[at] for c in x[:3]], None) for k in range(n + 1) for x in [_redrawn(first, samples, groups, pools, seed, k, ends) if k else first] for at in [np.argsort(x.code, kind="stable")]]
                it = np.repeat(np.arange(n + 1, dtype=np.int32), [len(x.code) for x in tables])
                value = np.concatenate([x.value for x in tables])
                whole = value.astype(np.int32) if value.max(initial=0) < 1 << 31 else value
                data = _stream(pa.table({"it": it, "sample": np.concatenate([x.sample for x in tables]).astype(np.int32), "feature": np.concatenate([x.code for x in tables]).astype(np.int32), "value": whole}))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(r, 1), batch.column("names").slice(r, 1), pa.array([data], pa.binary())], names=["block", "names", "cells"])

    return run


def _binned(rows: DataFrame, pool: DataFrame, features: DataFrame, measure: pairwise.Measure, n: int, seed: int) -> DataFrame:
    """``against_null`` for pools of any number of rows: every table is drawn once
    and kept by blocks, which then meet by partitions."""
    spark = rows.sparkSession
    sizes = running(pool.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "end", ["grp"], "n")
    bins = settled(sizes.select("grp", F.expr(f"cast((end - n) div {MOST_POOLED} as int)").alias("bin")))
    pooled = pool.join(features, "feature").join(bins, "grp").select("bin", "grp", "code", F.col("abundance").cast("double").alias("abundance"), F.col("weight").cast("double").alias("weight"))
    samples = rows.groupBy("sample").agg(F.first("grp").alias("grp"), F.count(F.lit(1)).alias("cells")).join(bins, "grp")
    placed = settled(numbered(samples.select("sample", "bin", "cells"), "place", "bin", "sample"))
    starts, blocks = [], 0
    # A row a bin, each of MOST_POOLED rows of pools or nearly so.
    for r in placed.groupBy("bin").agg(F.count(F.lit(1)).alias("s"), F.sum("cells").alias("cells"), F.min("place").alias("first")).sort("bin").collect():
        block = max(1, min(pairwise.BLOCK, STORED * r["s"] // (r["cells"] * (n + 1))))
        starts.append((r["bin"], r["first"], block, blocks))
        blocks += -(-r["s"] // block)
    first = F.broadcast(spark.createDataFrame(starts, "bin int, first long, block long, start int"))
    placed = placed.join(first, "bin").select("sample", "bin", F.expr("cast(start + (place - first) div block as int)").alias("block"))
    cells = rows.join(features, "feature").join(placed, "sample").select("block", "bin", "code", "sample", F.col("value").cast("double").alias("value"), "grp")
    held = settled(cells.repartitionByRange(blocks, "block").groupBy("block").applyInArrow(_pack_block, "block int, bin int, names binary, cells binary"))
    pools = settled(pooled.repartition(len(starts), "bin").groupBy("bin").applyInArrow(_pack_pool, "bin int, pools binary"))
    met = held.join(pools.withColumnRenamed("bin", "own").hint("shuffle_replicate_nl"), F.col("bin") == F.col("own"))
    # A partition a block again: blocks' partitions follow each other.
    kept = settled(met.coalesce(blocks).mapInArrow(_all_drawn(n, seed), "block int, names binary, cells binary"))
    return pairwise.met(kept, measure, True, n)


def against_null(rows: DataFrame, pool: DataFrame, distance: Distance, n: int, seed: int, block: int = SAMPLES) -> DataFrame:
    """s1 < s2, obs, null_mean, null_std, p, ses; ``rows`` has feature, sample,
    value, grp, and ``pool`` grp, feature, abundance, weight. ``rows`` are read
    several times."""
    if n < 1:
        raise ValueError("one iteration or more")
    spark = rows.sparkSession
    rows = rows.where("feature is not null and sample is not null").select("feature", "sample", "value", "grp")
    pool = settled(pool.where("feature is not null"))
    features = numbered(rows.select("feature").distinct(), "code", "feature").select("feature", (F.col("code") - 1).cast("int").alias("code"))
    size = rows.agg(F.countDistinct("feature").alias("f"), F.countDistinct("sample").alias("s"), F.count(F.lit(1)).alias("cells")).first()
    if not size["f"]:
        return spark.createDataFrame([], PAIRS)
    if pool.count() > MOST_POOLED:
        return _binned(rows, pool, features, distance.measure, n, seed)
    block = max(1, min(block, pairwise.CELLS * size["s"] // size["cells"]))
    blocks, chunks = -(-size["s"] // block), -(-n // CHUNK)
    tiles = blocks * (blocks + 1) // 2
    spans = max(1, min(chunks, -(-2 * spark.sparkContext.defaultParallelism // tiles)))
    placed = numbered(rows.select("sample").distinct(), "place", "sample").select("sample", F.expr(f"cast((place - 1) div {block} as int)").alias("block"))
    cell = F.struct("code", "sample", F.col("value").cast("double").alias("w"), "grp")
    held = settled(rows.join(features, "feature").join(placed, "sample").groupBy("block").agg(F.collect_list(cell).alias("rows")).repartitionByRange(blocks, "block"))
    tile, other = held.select(F.col("block").alias("a"), F.col("rows").alias("one")), held.select(F.col("block").alias("b"), F.col("rows").alias("two"))
    # Blocks meet by partitions: none is copied, unless iterations are shared out.
    work = tile.join(other.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b")).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    bound = lambda k: F.expr(f"cast(({k}) * {chunks} div {spans} as int)")
    work = work.select("a", "b", "one", "two", bound("span").alias("begin"), bound("span + 1").alias("end"))
    work = work.repartition(tiles * spans, "a", "b", "begin") if spans > 1 else work
    each = F.struct(F.col("grp"), F.col("code"), F.col("abundance").cast("double").alias("abundance"), F.col("weight").cast("double").alias("weight"))
    # One row of pools, of a checked number; features by name in each.
    pools = pool.join(features, "feature").agg(F.array_sort(F.collect_list(each)).alias("pool"))
    out = work.join(F.broadcast(pools)).mapInArrow(_spans(distance.measure, seed, n, size["f"]), PART)
    if spans == 1:  # a tile's chunks follow each other
        return out.mapInArrow(summaries(False), PAIRS)
    return out.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInArrow(summaries(False), PAIRS)
