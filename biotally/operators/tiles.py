"""Sums over what pairs of samples share, by tiles of two blocks of samples.

A join on a key that many samples have makes a row for each pair of them, and a
key that all have makes all pairs: the root of a tree, above all. Here a block's
rows are sent to the tiles it is part of, and a pair exists as a number in a
tile's array until its sum is whole. Keys that few samples have go by the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import settled

#: Samples of a block, about.
BLOCK = 128
#: Rows of a block that a tile gets at once, about; keys are dealt so.
ROWS = 1 << 18
#: Pairs of rows that are added up at once.
PAIRS = 1 << 21

#: Values of pairs of rows, from the columns of either (arrays of equal length).
Kernel = Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]


def _runs(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of their codes, and where each code's begin and how many."""
    counts = np.bincount(codes, minlength=n)
    return np.argsort(codes, kind="stable"), np.cumsum(counts) - counts, counts


def tile(one: list, two: list, kernel: Kernel, same: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """s1, s2, x of a tile: each side has samples, keys, and columns of numbers."""
    (sa, ka, *ca), (sb, kb, *cb) = one, two
    names = pa.concat_arrays([sa, sb]).dictionary_encode()
    keys = pa.concat_arrays([ka, kb]).dictionary_encode()
    samples, codes = names.indices.to_numpy(), keys.indices.to_numpy()
    n, width, m = len(sa), len(names.dictionary), len(keys.dictionary)
    oa, fa, na = _runs(codes[:n], m)
    ob, fb, nb = _runs(codes[n:], m)
    sums, touched = np.zeros(width * width), np.zeros(width * width, dtype=bool)
    pairs = na.astype(np.int64) * nb
    shared = np.flatnonzero(pairs)
    chunk = np.cumsum(pairs[shared]) // PAIRS
    for part in np.split(shared, np.flatnonzero(np.diff(chunk)) + 1) if len(shared) else []:
        # All pairs of rows of each key: first the key, then either side's place.
        each = pairs[part]
        key = np.repeat(part, each)
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        i, j = oa[fa[key] + at // nb[key]], ob[fb[key] + at % nb[key]]
        si, sj = samples[i], samples[n + j]
        if same:
            keep = si < sj
            i, j, si, sj = i[keep], j[keep], si[keep], sj[keep]
        cell = si.astype(np.int64) * width + sj
        sums += np.bincount(cell, kernel([c[i] for c in ca], [c[j] for c in cb]), minlength=width * width)
        touched[cell] = True
    found = np.flatnonzero(touched)
    take = lambda x: names.dictionary.take(pa.array(x))
    return take(found // width), take(found % width), sums[found]


def tiled_sums(rows: DataFrame, key: str, kernel: Kernel, blocks: int, parts: int) -> DataFrame:
    """s1 < s2, x over the rows' keys, in a row for each of the ``parts`` that the
    keys are dealt to; ``rows`` has key, sample and numbers."""
    cols = [c for c in rows.columns if c not in (key, "sample")]
    dealt = rows.select(F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.struct("sample", F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in cols]).alias("row"))
    groups = settled(dealt.groupBy("block", "part").agg(F.collect_list("row").alias("rows")))
    one = groups.select(F.col("block").alias("a"), "part", F.col("rows").alias("one"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("b"))
    met = one.join(groups.select(F.col("block").alias("b"), "part", F.col("rows").alias("two")), ["b", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(value) -> list:
            fields = value.values
            return [fields.field(0), fields.field(1), *[fields.field(k).to_numpy(zero_copy_only=False) for k in range(2, 2 + len(cols))]]

        for batch in batches:
            for r in range(batch.num_rows):
                a, b = batch.column("a")[r].as_py(), batch.column("b")[r].as_py()
                x, y, v = tile(side(batch.column("one")[r]), side(batch.column("two")[r]), kernel, a == b)
                first = pc.less(x, y)
                yield pa.RecordBatch.from_arrays([pc.if_else(first, x, y), pc.if_else(first, y, x), pa.array(v)], names=["s1", "s2", "x"])

    return met.select("a", "b", "one", "two").mapInArrow(run, "s1 string, s2 string, x double")


def split_sums(rows: DataFrame, key: str, join: Callable[[DataFrame], DataFrame], kernel: Kernel) -> DataFrame:
    """s1 < s2, x: by tiles over keys that so many samples have that a row each
    for their pairs would be more than what the tiles are sent, by ``join`` over
    the others. A table of a block's samples or fewer is joined. ``rows`` are read
    several times."""
    size = rows.agg(F.countDistinct("sample").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    blocks = -(-size["n"] // BLOCK)
    if blocks < 2:
        return join(rows)
    counted = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    many = F.col("_n") * BLOCK >= 2 * size["n"]
    parts = max(1, -(-size["rows"] // (blocks * ROWS)))
    heavy = tiled_sums(counted.where(many).drop("_n"), key, kernel, blocks, parts)
    return heavy.unionByName(join(counted.where(~many).drop("_n"))).groupBy("s1", "s2").agg(F.sum("x").alias("x"))
