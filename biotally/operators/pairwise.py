"""Dissimilarities of all pairs of samples, by tiles of two blocks of samples.

A block's rows are packed once; blocks meet partition by partition, so that
neither pairs nor what two samples share are ever shuffled or written: disk
follows the table's cells, not its pairs. A task holds two blocks of a bounded
number of samples and cells, and an array of their pairs.

Defined cases: values that are not positive and rows without a sample take no
part; rows without a feature count in their sample's total and are shared by
none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hill import is_one
from .moments import MOMENTS, PAIRS as SUMMARY
from .moments import merged, summarized, summed
from .relational import settled

#: Samples and cells of a block, about.
BLOCK = 1024
CELLS = 1 << 20
#: Cells of a sample, at most: larger ones are joined.
MOST_CELLS = 1 << 20
#: Iterations whose dissimilarities are held at once.
HELD = 8
#: Pairs of rows that are added up, and pairs of samples that are given out, at once.
PAIRS = 1 << 21
OUT = 1 << 17


class Measure(NamedTuple):
    """``columns``: of each row's share; ``total``: of a sample's rows, summed;
    ``both``: what two rows of a feature add; ``value``: of the sums (pairs) and
    totals (lists of columns and rows)."""

    columns: Callable[[np.ndarray], list[np.ndarray]]
    totals: Callable[[np.ndarray], list[np.ndarray]]
    both: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]
    value: Callable[[np.ndarray, list[np.ndarray], list[np.ndarray]], np.ndarray]


def bray() -> Measure:
    return Measure(lambda p: [p], lambda p: [], lambda a, b: np.minimum(a[0], b[0]), lambda x, a, b: 1 - x)


def jaccard() -> Measure:
    return Measure(lambda p: [], lambda p: [np.ones_like(p)], lambda a, b: None, lambda x, a, b: 1 - x / (a[0] + b[0] - x))


def naive(q: float) -> Measure:
    """The ratio of pooled and mean numbers of types."""

    def term(x: np.ndarray) -> np.ndarray:
        return x * np.log(x) if is_one(q) else x ** float(q)

    def number(x: np.ndarray) -> np.ndarray:
        return np.exp(-x) if is_one(q) else x ** (1 / (1 - q))

    def both(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        return term(a[0] + b[0]) - a[1] - b[1]

    def value(x: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        return number(a[1] + b[1] + x) / number((a[0] + b[0]) / 2)

    return Measure(lambda p: [p / 2, term(p / 2)], lambda p: [term(p), term(p / 2)], both, value)


def _pack(table: pa.Table) -> pa.Table:
    """A block as one row: its samples by name, and its cells."""
    table = table.combine_chunks()
    names = table["sample"].combine_chunks().dictionary_encode()
    order = np.array(sorted(range(len(names.dictionary)), key=names.dictionary.to_pylist().__getitem__))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    cells = pa.table({"it": table["it"], "sample": place[names.indices.to_numpy()], "feature": table["feature"], "value": table["value"]})
    data = []
    for t in (pa.table({"name": names.dictionary.take(pa.array(order))}), cells):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(t)
        data.append(sink.getvalue().to_pybytes())
    return pa.table({"block": table["block"].slice(0, 1), "names": pa.array(data[:1], pa.binary()), "cells": pa.array(data[1:], pa.binary())})


def _columns(data: pa.Scalar, *names: str) -> list[pa.Array]:
    table = pa.ipc.open_stream(data.as_buffer()).read_all()
    return [table[c].combine_chunks() for c in names]


def shared(codes: list[np.ndarray], samples: list[np.ndarray], columns: list[list[np.ndarray]], sizes: tuple[int, int], features: int, both: Callable) -> np.ndarray:
    """Sums of ``both`` over the features that two samples share, for all pairs of
    a sample of the first side and one of the second."""
    (ca, cb), (sa, sb), (xa, xb) = codes, samples, columns
    counts = np.bincount(cb, minlength=features)
    first = np.cumsum(counts) - counts
    order = None if (cb[1:] >= cb[:-1]).all() else np.argsort(cb, kind="stable")
    rows = np.flatnonzero(counts[ca])
    each = counts[ca[rows]]
    out = np.zeros(sizes[0] * sizes[1])
    chunk = np.cumsum(each) // PAIRS
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(chunk)) + 1) if len(rows) else []:
        n = each[part]
        i = np.repeat(rows[part], n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[ca[rows[part]]], n)
        j = j if order is None else order[j]
        x = both([c[i] for c in xa], [c[j] for c in xb])
        out += np.bincount(sa[i].astype(np.int64) * sizes[1] + sb[j], x, minlength=len(out))
    return out.reshape(sizes)


def regional(q: float) -> Measure:
    """The regional dissimilarity by ``naive``'s ratio."""
    ratio = naive(q)

    def value(x: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        beta = ratio.value(x, a, b)
        low = 2.0 ** (q - 1)
        return np.log(beta) / np.log(2) if is_one(q) else 1 - (beta ** (q - 1) - low) / (1 - low)

    return ratio._replace(value=value)


class Side(NamedTuple):
    sample: np.ndarray
    code: np.ndarray
    value: np.ndarray
    known: np.ndarray


def _compared(measure: Measure, relative: bool, one: Side, two: Side, sizes: tuple[int, int], features: int) -> np.ndarray:
    """Dissimilarities of one table's two blocks."""
    columns, totals = [], []
    for side, n in zip((one, two), sizes, strict=True):
        p = side.value / np.bincount(side.sample, side.value, minlength=n)[side.sample] if relative else side.value
        columns.append([c[side.known] for c in measure.columns(p)])
        totals.append([np.bincount(side.sample, t, minlength=n) for t in measure.totals(p)])
    x = shared([s.code[s.known] for s in (one, two)], [s.sample[s.known] for s in (one, two)], columns, sizes, features, measure.both)
    return measure.value(x, [t[:, None] for t in totals[0]], [t[None] for t in totals[1]])


def _against(tables: Iterator[np.ndarray]) -> list[np.ndarray]:
    """obs, null_mean, null_std, p, ses of the tables' values, the observed first."""
    obs, found, each = next(tables).ravel(), None, []

    def folded() -> dict:
        m = summed(np.stack([obs, *each]))
        each.clear()
        return m if found is None else merged(found, m)

    for x in tables:
        each.append(x.ravel())
        if len(each) == HELD:
            found = folded()
    found = folded() if each or found is None else found
    return summarized([found[k] for k in MOMENTS])


def _sides(get: Callable, same: bool, its: int) -> tuple:
    """Names of both blocks, how many features, and both sides by iteration."""
    blocks = [(*_columns(get(f"names{k}"), "name"), *_columns(get(f"cells{k}"), "it", "sample", "feature", "value")) for k in ((1,) if same else (1, 2))]
    keys = pa.concat_arrays([x[3] for x in blocks])
    if pa.types.is_integer(keys.type):  # numbered from 0, none of them null
        codes, known = keys.to_numpy(), np.ones(len(keys), dtype=bool)
        features = int(codes.max(initial=-1)) + 1
    else:
        keys = keys.dictionary_encode()
        codes, known = keys.indices.fill_null(0).to_numpy(), pc.is_valid(keys.indices).to_numpy(zero_copy_only=False)
        features = len(keys.dictionary)
    out, begin = [], 0
    for _, it, sample, feature, value in blocks:
        it, end = it.to_numpy(), begin + len(feature)
        whole = [sample.to_numpy(), codes[begin:end], value.to_numpy(), known[begin:end]]
        if (it[1:] < it[:-1]).any():
            order = np.argsort(it, kind="stable")
            it, whole = it[order], [x[order] for x in whole]
        cut = np.searchsorted(it, np.arange(its + 2))
        out.append(lambda k, whole=whole, cut=cut: Side(*[x[cut[k] : cut[k + 1]] for x in whole]))
        begin = end
    return blocks[0][0], blocks[-1][0], features, out[0], out[-1]


def _tiles(measure: Measure, relative: bool, its: int):
    """The work on two blocks: values of pairs, or what ``its`` iterations say of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                same = get("a").as_py() == get("b").as_py()
                one, two, features, first, second = _sides(get, same, its)
                n, m = len(one), len(two)
                tables = (_compared(measure, relative, first(k), second(k), (n, m), features) for k in range(its + 1))
                values = [x.reshape(n, m) for x in (_against(tables) if its else [next(tables)])]
                names = pa.concat_arrays([one, two])
                rank = np.empty(n + m, dtype=np.int64)
                rank[np.array(sorted(range(n + m), key=names.to_pylist().__getitem__))] = np.arange(n + m)
                step = max(1, OUT // m)
                for begin in range(0, n, step):
                    i, j = np.divmod(np.arange(begin * m, min(n, begin + step) * m), m)
                    if same:
                        i, j = i[i < j], j[i < j]
                    less = rank[i] < rank[n + j]
                    left, right = np.where(less, i, n + j), np.where(less, n + j, i)
                    numbers = [pa.array(x[i, j], from_pandas=bool(its)) for x in values]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(left)), names.take(pa.array(right)), *numbers], names=["s1", "s2", *(["obs", "null_mean", "null_std", "p", "ses"] if its else ["value"])])

    return run


def all_pairs(tab: DataFrame, measure: Measure, relative: bool = True, its: int = 0, repeated: bool = False) -> DataFrame | None:
    """s1 < s2, value; None if the table's ids are no texts or a sample is too
    large for a task. ``tab`` is read twice. With ``its``, ``tab`` has a table for
    each it from 0 (observed) to that, and the result obs, null_mean, null_std,
    p, ses: a pair's values of all tables are in one task. ``repeated``: a cell may
    have several rows; they are added up behind the shuffle to blocks, so that
    the table needs none of its own."""
    schema = SUMMARY if its else "s1 string, s2 string, value double"
    kinds = dict(tab.dtypes)
    if kinds["sample"] != "string" or kinds["feature"] != "string":
        return None
    rows = tab.where("sample is not null" if repeated else "value > 0 and sample is not null").select((F.col("it").cast("int") if its else F.lit(0)).alias("it"), "sample", "feature", F.col("value").cast("double").alias("value"))
    size = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("cells"), F.max("n").alias("most")).first()
    if not size["samples"]:
        return tab.sparkSession.createDataFrame([], schema)
    if size["most"] > MOST_CELLS:
        return None
    blocks = max(-(-size["samples"] // BLOCK), -(-size["cells"] // CELLS))
    # Dealt before they are packed: ranges are sampled, which would pack twice.
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int")).repartitionByRange(blocks, "block")
    if repeated:
        blocked = blocked.groupBy("it", "sample", "feature", "block").agg(F.sum("value").alias("value")).where("value > 0").select("it", "sample", "feature", "value", "block")
    held = settled(blocked.groupBy("block").applyInArrow(_pack, "block int, names binary, cells binary"))
    return met(held, measure, relative, its)


def met(held: DataFrame, measure: Measure, relative: bool, its: int) -> DataFrame:
    """``all_pairs`` of packed blocks (block, names, cells). Blocks meet by
    partitions: a block is read by many tasks and written once."""
    schema = SUMMARY if its else "s1 string, s2 string, value double"
    a, b = (held.select(F.col("block").alias(x), F.col("names").alias(f"names{k}"), F.col("cells").alias(f"cells{k}")) for k, x in ((1, "a"), (2, "b")))
    return a.join(b.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b")).mapInArrow(_tiles(measure, relative, its), schema)


class Pairs(NamedTuple):
    """Dissimilarities that are made in blocks where a matrix is wanted, without a
    row a pair. ``rows``: the same of ``tab`` as rows (s1 < s2, value)."""

    tab: DataFrame
    measure: Measure
    rows: Callable[[DataFrame], DataFrame]

    @property
    def sparkSession(self):  # noqa: N802
        return self.tab.sparkSession


def matrix(pairs: Pairs, samples: DataFrame, n: int, size: int, encoded: Callable[[np.ndarray], bytes]) -> DataFrame:
    """i <= j, data, total: blocks of -value^2 / 2 of the ``n`` ``samples`` (sample,
    at from 0), ``size`` of them a block and none of over ``MOST_CELLS`` cells. The
    table's cells are shuffled to their blocks, and blocks meet by partitions."""
    rows = pairs.tab.where("value > 0").join(samples, "sample")
    blocked = rows.select(F.lit(0).alias("it"), F.col("at").cast("int").alias("sample"), "feature", F.col("value").cast("double").alias("value"), F.expr(f"cast(at div {size} as int)").alias("block"))
    held = settled(blocked.repartitionByRange(-(-n // size), "block").groupBy("block").applyInArrow(_pack, "block int, names binary, cells binary"))
    a, b = (held.select(F.col("block").alias(x), F.col("names").alias(f"names{k}"), F.col("cells").alias(f"cells{k}")) for k, x in ((1, "a"), (2, "b")))
    measure = pairs.measure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                i, j = get("a").as_py(), get("b").as_py()
                one, two, features, first, second = _sides(get, i == j, 0)
                x = _compared(measure, True, first(0), second(0), (len(one), len(two)), features)
                x = x * x * -0.5
                if i == j:
                    x = np.triu(x, 1)
                    x += x.T
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([encoded(x)], pa.binary()), pa.array([float(x.sum()) * (1 if i == j else 2)])], names=["i", "j", "data", "total"])

    return a.join(b.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b")).mapInArrow(run, "i int, j int, data binary, total double")
