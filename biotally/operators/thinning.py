"""Thinning on counts: reads are drawn without a row for each read.

Drawing n of a sample's reads without replacement gives its features counts of
the multivariate hypergeometric distribution. It is drawn by halves: of n reads
so many fall into the first half of the features (a hypergeometric number), the
rest into the second, and so on down to single features. Each number is found
by adding up the distribution from its mode outwards until a uniform number is
passed, which is a hash of what the draw is for. Work and rows follow the cells
of the table, not its reads.

A sample of at most ``WHOLE`` reads is one row, and its reads are put in a random
order: that is less work than halves are, once for all depths.

The features of a larger sample are dealt to ``2 ** BITS`` parts by their names' hashes; one
row holds a part's features. Reads are first drawn for the parts, then within
each, so that no task holds a sample. Several depths of a sample are drawn one
from the other, as if from one order of its reads.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import digests
from .relational import settled

BITS = 8
#: Reads of a sample that are put in order in one row, at most.
WHOLE = 1 << 20
#: Rows that are given out at once, about.
OUT = 1 << 17
#: Factorials up to here are added up, above from Stirling's series.
_SMALL = 1024


def log_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])
    big = np.maximum(n, _SMALL)
    series = (big + 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1).astype(np.int64)], series)


def hypergeometric(total: np.ndarray, own: np.ndarray, n: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of ``n`` drawn from ``total`` are among the ``own``, for uniform
    numbers ``u``: values are taken from the mode outwards, the upper one first,
    until their probabilities pass ``u``."""
    total, own, n = (np.asarray(x, dtype=np.int64) for x in (total, own, n))
    low, high = np.maximum(0, n - (total - own)), np.minimum(n, own)
    t, k, m = (x.astype(float) for x in (total, own, n))
    mode = np.clip(np.floor((m + 1) * (k + 1) / (t + 2)).astype(np.int64), low, high)
    f = log_factorial
    x = mode.astype(float)
    p = np.exp(f(k) - f(x) - f(k - x) + f(t - k) - f(m - x) - f(t - k - m + x) - f(t) + f(m) + f(t - m))
    out = mode.copy()
    live = np.flatnonzero((low < high) & (p < u))
    up, down, above, below, passed = mode[live], mode[live], p[live], p[live], p[live]
    while len(live):
        t_, k_, n_ = total[live], own[live], n[live]
        rise = up < high[live]
        above = np.where(rise, above * ((k_ - up).astype(float) * (n_ - up)) / ((up + 1).astype(float) * np.maximum(t_ - k_ - n_ + up + 1, 1)), 0)
        up = up + rise
        first = rise & (passed + above >= u[live])
        passed = passed + above
        fall = down > low[live]
        below = np.where(fall, below * (down.astype(float) * (t_ - k_ - n_ + down)) / ((k_ - down + 1).astype(float) * (n_ - down + 1)), 0)
        down = down - fall
        second = ~first & fall & (passed + below >= u[live])
        passed = passed + below
        # What rounding of the first probability leaves goes to the end of the tail.
        over = ~first & ~second & ((~(up < high[live]) & ~(down > low[live])) | (above + below < 1e-17 * passed))
        out[live] = np.where(first | (over & rise), up, np.where(second | over, down, out[live]))
        go = ~(first | second | over)
        live, up, down, above, below, passed = (x[go] for x in (live, up, down, above, below, passed))
    return out


def _uniform(name: str) -> float:
    return (int.from_bytes(hashlib.md5(name.encode()).digest()[:6], "big") + 0.5) / 281474976710656.0


def halved(values: np.ndarray, ends: np.ndarray, n: np.ndarray, names: list[str]) -> np.ndarray:
    """Draws from groups of counts: ``ends`` closes each group in ``values``, of
    which ``n`` are drawn. All groups go down their halves together; a draw's
    uniform number is a hash of its group's name and the half."""
    sums = np.concatenate([[0], np.cumsum(values)])
    first = np.concatenate([[0], ends[:-1]])
    a, b, group, drawn = first, ends, np.arange(len(ends)), n
    out = np.zeros(len(values), dtype=np.int64)
    while len(a):
        single = b - a == 1
        out[a[single]] = drawn[single]
        go = (b - a > 1) & (drawn > 0)
        a, b, group, drawn = a[go], b[go], group[go], drawn[go]
        if not len(a):
            break
        middle = (a + b) // 2
        total, own = sums[b] - sums[a], sums[middle] - sums[a]
        base = first[group]
        u = np.fromiter((_uniform(f"{names[g]}:{i}:{j}") for g, i, j in zip(group.tolist(), (a - base).tolist(), (b - base).tolist(), strict=True)), dtype=float, count=len(a))
        left = hypergeometric(total, own, drawn, u)
        a, b = np.concatenate([a, middle]), np.concatenate([middle, b])
        group, drawn = np.concatenate([group, group]), np.concatenate([left, drawn - left])
    return out


def _thin(groups: DataFrame, seed: int) -> DataFrame:
    """(sample, part, names, counts, depths, ns) -> sample, depth, name, n: of
    each group's counts ``ns`` are drawn for its ``depths``, largest first, each
    from what the one before has drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sample, part = batch.column("sample"), batch.column("part").to_pylist()
            counts, names = batch.column("counts"), batch.column("names").flatten()
            ends = np.cumsum(counts.value_lengths().to_numpy(zero_copy_only=False))
            sizes = np.diff(ends, prepend=0)
            values = counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            depths, ns = batch.column("depths").to_pylist(), batch.column("ns").to_pylist()
            for k in range(max(map(len, ns))):
                has = [k < len(x) for x in ns]
                n = np.array([x[k] if h else 0 for x, h in zip(ns, has, strict=True)], dtype=np.int64)
                depth = np.array([x[k] if h else 0 for x, h in zip(depths, has, strict=True)], dtype=np.int64)
                values = halved(values, ends, n, [f"{seed}:{s}:{p}:{d}" for s, p, d in zip(sample.to_pylist(), part, depth.tolist(), strict=True)])
                kept = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays([sample.take(pa.array(row[kept])), pa.array(depth[row[kept]]), names.take(pa.array(kept)), pa.array(values[kept])], names=["sample", "depth", "name", "n"])

    return groups.select("sample", "part", "names", "counts", "depths", "ns").mapInArrow(run, "sample string, depth long, name string, n long")


def firsts(counts: np.ndarray, depths: np.ndarray, name: str) -> np.ndarray:
    """How often each of the counted is among the first reads of one random order,
    for ``depths`` in ascending order: depths x counts. ``name`` seeds the order."""
    rng = np.random.default_rng(int.from_bytes(hashlib.md5(name.encode()).digest(), "big"))
    order = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rng.shuffle(order)
    return _among_firsts(order, len(counts), depths)


def _among_firsts(order: np.ndarray, width: int, depths: np.ndarray) -> np.ndarray:
    between = np.repeat(np.arange(len(depths)), np.diff(depths, prepend=0))
    return np.bincount(between * width + order[: len(between)], minlength=len(depths) * width).reshape(len(depths), -1).cumsum(axis=0)


def keyed_firsts(counts: np.ndarray, depths: np.ndarray, names: list[bytes]) -> np.ndarray:
    """``firsts`` in the order of the reads' md5 keys, each a name and the read's
    number from 1; equal keys are in the order of the counts."""
    which = np.repeat(np.arange(len(counts)), counts)
    i = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    high, low = digests.numbered(names, which, i).view(">u8").T.astype(np.uint64)
    order = np.argsort(high)
    if (high[order[1:]] == high[order[:-1]]).any():
        order = np.lexsort((low, high))
    return _among_firsts(which[order], len(counts), depths)


def in_order(groups: DataFrame, seed: int, keys: bool = False) -> DataFrame:
    """(sample, names, counts, depths) -> sample, depth, feature, n. ``keys``: in
    the order of md5 keys."""

    def found_of(sample, names: pa.Array, counts: np.ndarray, depths: np.ndarray) -> np.ndarray:
        if not keys:
            return firsts(counts, depths, f"{seed}:{sample}")
        return keyed_firsts(counts, depths, [f"{seed}:{sample}:{'' if x is None else f'{x}:'}".encode() for x in names.to_pylist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, names = batch.column("sample"), batch.column("names").flatten()
            counts, depths = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("counts", "depths"))
            ends, stops = (np.cumsum(batch.column(c).value_lengths().to_numpy(zero_copy_only=False)) for c in ("counts", "depths"))
            held, size = [], 0
            for row, sample in enumerate(samples.to_pylist()):
                begin, own = ends[row - 1] if row else 0, depths[stops[row - 1] if row else 0 : stops[row]]
                found = found_of(sample, names[begin : ends[row]], counts[begin : ends[row]], own)
                at, which = np.nonzero(found)
                held.append((np.full(len(at), row), own[at], which + begin, found[at, which]))
                size += len(at)
                if size >= OUT or row + 1 == len(samples):
                    of, depth, name, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield pa.RecordBatch.from_arrays([samples.take(pa.array(of)), pa.array(depth), names.take(pa.array(name)), pa.array(n.astype(float))], names=["sample", "depth", "feature", "n"])
                    held, size = [], 0

    kinds = dict(groups.dtypes)
    return groups.select("sample", "names", "counts", "depths").mapInArrow(run, f"sample {kinds['sample']}, depth long, feature {kinds['names'][6:-1]}, n double")


def drawn(tab: DataFrame, depths: DataFrame, seed: int) -> DataFrame:
    """sample, depth, feature, n: features' counts among ``depth`` reads of their
    sample. ``depths`` has sample and depth, any number of them a sample, none
    above its reads. ``tab`` is read several times; nothing of it is shuffled, but
    for large samples, if it is dealt by samples."""
    cells = tab.select("sample", "feature", F.floor("value").cast("long").alias("value")).where("value > 0")
    wanted = depths.where("depth > 0").select("sample", F.col("depth").cast("long").alias("depth")).groupBy("sample").agg(F.sort_array(F.collect_set("depth")).alias("depths"))
    large = settled(cells.groupBy("sample").agg(F.sum("value").alias("reads")).where(F.col("reads") > WHOLE).select("sample"))
    some = not large.isEmpty()
    small = cells.join(large, "sample", "left_anti") if some else cells
    items = F.sort_array(F.collect_list(F.struct("feature", "value")))
    lists = small.groupBy("sample").agg(items.alias("items")).join(wanted, "sample")
    out = in_order(lists.select("sample", F.col("items.feature").alias("names"), F.col("items.value").alias("counts"), "depths"), seed)
    return out.unionByName(_by_parts(cells.join(large, "sample", "left_semi"), wanted, seed)) if some else out


def _by_parts(cells: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``drawn`` of cells (sample, feature, value) for lists of depths, by halves."""
    part = F.substring(F.md5(F.col("feature").cast("binary")), 1, BITS // 4)
    cells, wanted = cells.withColumn("part", part), wanted.withColumn("depths", F.reverse("depths"))
    items = F.sort_array(F.collect_list(F.struct("feature", "value")))
    parts = settled(cells.groupBy("sample", "part").agg(items.alias("items"), F.sum("value").alias("total")))
    # A row a sample, of at most 2 ** BITS totals.
    tops = parts.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("part", "total"))).alias("items")).join(wanted, "sample")
    of_parts = _thin(tops.select("sample", F.lit("").alias("part"), F.col("items.part").alias("names"), F.col("items.total").alias("counts"), "depths", F.col("depths").alias("ns")), seed)
    ns = of_parts.groupBy("sample", F.col("name").alias("part")).agg(F.sort_array(F.collect_list(F.struct("depth", "n")), asc=False).alias("d"))
    groups = parts.join(ns, ["sample", "part"]).select("sample", "part", F.col("items.feature").alias("names"), F.col("items.value").alias("counts"), F.col("d.depth").alias("depths"), F.col("d.n").alias("ns"))
    return _thin(groups, seed).select("sample", "depth", F.col("name").alias("feature"), F.col("n").cast("double").alias("n"))
