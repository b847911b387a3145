"""Null models by moments: no row for an iteration, sample and feature.

Samples come in blocks, and so do the rows of the distance matrix. A task gets
two blocks of samples, a part of the matrix and a span of iterations; it makes
each iteration's permutation itself, from the same hashes as ``nulls.permuted``,
and works on arrays. What leaves a task is a number for each pair of samples
and iteration where the matrix has several parts, which are then added up, and
else only counts, means and sums of squares for the span, which are merged as
Chan, Golub and LeVeque do. Values are those of ``nulls``.

Defined cases: rows without a feature or sample take no part; a pair of features
without a distance adds nothing and is nobody's neighbour; distances are
symmetric and given once in each direction; an empty table gives no rows.
Features' names go to every task: ``MOST_FEATURES`` is their checked bound, and
``nulls`` with ``arrays=False`` has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import numbered, settled

#: Features whose names fit in every task.
MOST_FEATURES = 1 << 20
#: Samples of a block, at most, and numbers in its weights.
BLOCK = 128
WEIGHTS = 1 << 23
#: Distances in a part of the matrix.
CELLS = 1 << 20
#: Numbers that leave a task in one row.
NUMBERS = 1 << 17

Sums = Callable[..., np.ndarray]

_SUMMARY = "obs double, null_mean double, null_std double, p double, ses double"
SAMPLES, PAIRS = f"sample string, {_SUMMARY}", f"s1 string, s2 string, {_SUMMARY}"


def order(names: list[bytes], prefix: str) -> np.ndarray:
    """Features in the order of their keys' md5 hashes: the k-th feature by name
    moves to the k-th of these."""
    base, raw = hashlib.md5(prefix.encode()), bytearray()
    for name in names:
        h = base.copy()
        h.update(name)
        raw += h.digest()
    k = np.frombuffer(bytes(raw), dtype=">u8").reshape(-1, 2)
    return np.lexsort((k[:, 1], k[:, 0]))


def moved(w: np.ndarray, samples: list[str], names: list[bytes], seed: int, it: int, within: bool, whole: np.ndarray | None) -> np.ndarray:
    """Weights (features x samples) of an iteration; ``whole`` is the order that
    holds for all samples, unless features move ``within`` each."""
    if it == 0:
        return w
    out = np.empty_like(w)
    if not within:
        out[whole] = w
        return out
    for s, sample in enumerate(samples):
        out[order(names, f"{seed}:{it}:{sample}:"), s] = w[:, s]
    return out


def _near(far: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row of the part and each sample, the least distance to a feature
    that the sample has; infinite if there is none."""
    return np.stack([far[:, w[:, s] > 0].min(axis=1, initial=np.inf) for s in range(w.shape[1])], axis=1)


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def mean_pairwise(d, far, rows, a, b) -> np.ndarray:
    z, k = a.sum(axis=0), (a > 0).sum(axis=0)
    rest = z * z - (a * a).sum(axis=0)
    g = (a[rows] * (d @ a)).sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((k >= 2) & (rest != 0), g / rest, np.nan)[None]


def mean_nearest(d, far, rows, a, b) -> np.ndarray:
    near, w = _near(far, a), a[rows]
    return np.stack([(w * _finite(near)).sum(axis=0), (w * np.isfinite(near)).sum(axis=0)])


def between_pairwise(d, far, rows, a, b) -> np.ndarray:
    z = np.outer(a.sum(axis=0), b.sum(axis=0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(z != 0, a[rows].T @ (d @ b) / z, np.nan)[None]


def between_nearest(d, far, rows, a, b) -> np.ndarray:
    one = a[rows].T @ _finite(_near(far, b)) / a.sum(axis=0)[:, None]
    two = (b[rows].T @ _finite(_near(far, a)) / b.sum(axis=0)[:, None]).T
    return ((one + two) / 2)[None]


def _ratio(x: np.ndarray) -> np.ndarray:
    """Iterations x (sums, weights) x cells -> iterations x cells."""
    if x.shape[1] == 1:
        return x[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x[:, 1] > 0, x[:, 0] / x[:, 1], np.nan)


def summed(x: np.ndarray) -> dict[str, np.ndarray]:
    """Of values, the observed ones first: how many iterations there are and are
    known, their means and sums of squares, and how many are less or equal."""
    obs, null = x[0], x[1:]
    known = np.isfinite(null)
    n = known.sum(axis=0)
    mean = np.where(known, null, 0.0).sum(axis=0) / np.maximum(n, 1)
    square = (np.where(known, null - mean, 0.0) ** 2).sum(axis=0)
    v, o = np.round(null, 10), np.round(obs, 10)
    return {"obs": obs, "n": np.full(len(obs), float(len(null))), "known": n.astype(float), "mean": mean, "square": square, "less": (v < o).sum(axis=0).astype(float), "equal": (v == o).sum(axis=0).astype(float)}


def merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of two sets of iterations together."""
    n = a["known"] + b["known"]
    apart = b["mean"] - a["mean"]
    share = b["known"] / np.maximum(n, 1)
    out = {k: a[k] + b[k] for k in ("n", "known", "less", "equal")}
    return out | {"obs": a["obs"], "mean": a["mean"] + apart * share, "square": a["square"] + b["square"] + apart**2 * a["known"] * share}


MOMENTS = ("obs", "n", "known", "mean", "square", "less", "equal")
PART = "a int, b int, chunk int, part int, one array<string>, two array<string>, x array<double>"


def _lists(values: list) -> pa.Array:
    """An Arrow list column from arrays, without a Python object a number."""
    ends = np.cumsum([0, *[len(v) for v in values]])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(values)) if isinstance(values[0], np.ndarray) else pa.array([x for v in values for x in v], type=pa.string()))


def part_row(a: int, b: int, chunk: int, part: int, one: list[str], two: list[str], x: np.ndarray) -> pa.RecordBatch:
    whole = [pa.array([v], type=pa.int32()) for v in (a, b, chunk, part)]
    return pa.RecordBatch.from_arrays([*whole, _lists([one]), _lists([two]), _lists([np.ascontiguousarray(x, dtype=float).ravel()])], names=["a", "b", "chunk", "part", "one", "two", "x"])


def block_weights(rows: pa.StructArray, features: int) -> tuple[list[str], np.ndarray]:
    """Samples by name, and the weights of a block, features x samples."""
    code, sample, w = (rows.field(k) for k in range(3))
    names = sample.dictionary_encode()
    by_name = sorted(range(len(names.dictionary)), key=names.dictionary.to_pylist().__getitem__)
    place = np.empty(len(by_name), dtype=np.int64)
    place[by_name] = np.arange(len(by_name))
    out = np.zeros((features, len(by_name)))
    out[code.to_numpy(), place[names.indices.to_numpy()]] = w.to_numpy()
    return [names.dictionary[k].as_py() for k in by_name], out


def _matrix(rows: pa.StructArray, first: int, height: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """A part of the matrix: with zeros, and with infinity, where there is no distance."""
    i, j, d = (rows.field(k).to_numpy() for k in range(3))
    near = np.zeros((height, features))
    np.add.at(near, (i - first, j), d)
    far = np.full((height, features), np.inf)
    other = i != j
    np.minimum.at(far, (i[other] - first, j[other]), d[other])
    return near, far


def _spans(sums: Sums, own: bool, seed: int, n: int, within: bool, high: int, single: bool, conspecifics: bool):
    """The work on a row: a tile, a part of the matrix and a span of chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                a, b, part = get("a").as_py(), get("b").as_py(), get("part").as_py()
                names = [x.encode() for x in get("names").as_py()]
                one, wa = block_weights(get("one").values, len(names))
                two, wb = (one, wa) if own or a == b else block_weights(get("two").values, len(names))
                first = part * high
                height = min(high, len(names) - first)
                rows = slice(first, first + height)
                d, far = _matrix(get("d").values, first, height, len(names))
                if conspecifics:
                    far[np.arange(height), first + np.arange(height)] = 0.0
                observed = sums(d, far, rows, wa, wb)
                for chunk in range(get("begin").as_py(), get("end").as_py()):
                    each = [observed]
                    for it in range(chunk * get("size").as_py() + 1, min(n, (chunk + 1) * get("size").as_py()) + 1):
                        whole = None if within else order(names, f"{seed}:{it}:")
                        pa_ = moved(wa, one, names, seed, it, within, whole)
                        pb_ = pa_ if wb is wa else moved(wb, two, names, seed, it, within, whole)
                        each.append(sums(d, far, rows, pa_, pb_))
                    x = np.stack(each).reshape(len(each), observed.shape[0], -1)
                    if single:
                        m = summed(_ratio(x))
                        x = np.stack([m[k] for k in MOMENTS])
                    yield part_row(a, b, chunk, part, one, two, x)

    return run


def _fold(batches: Iterator[pa.RecordBatch], join: Callable, done: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of one key after another, ``join``ed to one row each."""
    key, held = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in ("a", "b", "chunk", "one", "two", "x")}
            now, held_now = join(row)
            if now == key:
                held["x"] = held_now(held["x"], row["x"].values.to_numpy())
                continue
            if held is not None:
                yield done(held)
            key, held = now, row | {"x": row["x"].values.to_numpy().copy()}
    if held is not None:
        yield done(held)


def _added(kinds: int):
    """Parts of the matrix are added up, chunk by chunk."""

    def done(row: dict) -> pa.RecordBatch:
        one, two = row["one"].as_py(), row["two"].as_py()
        cells = len(one) * len(two) if kinds == 1 and row["pairs"] else len(one)
        m = summed(_ratio(row["x"].reshape(-1, kinds, cells)))
        return part_row(row["a"].as_py(), row["b"].as_py(), row["chunk"].as_py(), 0, one, two, np.stack([m[k] for k in MOMENTS]))

    return done


def _whole_values(kinds: int, own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = _added(kinds)
        return _fold(batches, lambda row: ((row["a"].as_py(), row["b"].as_py(), row["chunk"].as_py()), np.add), lambda row: done(row | {"pairs": not own}))

    return run


def summarized(moments: list[np.ndarray]) -> list[np.ndarray]:
    """obs, null_mean, null_std, p, ses, NaN where they are not defined."""
    obs, n, known, mean, square, less, equal = moments
    all_ = known == n
    with np.errstate(divide="ignore", invalid="ignore"):
        std = np.where(all_ & (n > 1), np.sqrt(square / (n - 1)), np.nan)
        mean = np.where(all_, mean, np.nan)
        p = np.where(np.isnan(obs), np.nan, (less + 0.5 * equal) / n)
        ses = np.where(np.round(std, 10) > 0, (mean - obs) / std, np.nan)
    return [obs, mean, std, p, ses]


def summaries(own: bool):
    """Chunks are merged, and a tile's cells become rows."""

    def unpacked(x: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(MOMENTS, x.reshape(len(MOMENTS), -1), strict=True))

    def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = merged(unpacked(x), unpacked(y))
        return np.stack([m[k] for k in MOMENTS]).ravel()

    def done(row: dict) -> pa.RecordBatch:
        one, two, m = row["one"].as_py(), row["two"].as_py(), unpacked(row["x"])
        if own:
            cells, ids = np.arange(len(one)), [pa.array(one)]
        else:
            i, j = np.divmod(np.arange(len(one) * len(two)), len(two))
            cells = np.flatnonzero(i < j) if row["a"].as_py() == row["b"].as_py() else np.arange(len(i))
            ids = [pa.array(one).take(pa.array(i[cells])), pa.array(two).take(pa.array(j[cells]))]
        numbers = [pa.array(x, from_pandas=True) for x in summarized([m[k][cells] for k in MOMENTS])]
        return pa.RecordBatch.from_arrays([*ids, *numbers], names=[*(["sample"] if own else ["s1", "s2"]), "obs", "null_mean", "null_std", "p", "ses"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold(batches, lambda row: ((row["a"].as_py(), row["b"].as_py()), join), done)

    return run


def against_null(w: DataFrame, distmat: DataFrame, sums: Sums, n: int, seed: int, randomization: str = "features", *, own: bool, conspecifics: bool = False, cells: int = CELLS, block: int = BLOCK, numbers: int = NUMBERS) -> DataFrame:
    """sample (``own``) or s1 < s2, then obs, null_mean, null_std, p, ses, of
    ``n`` iterations; ``w`` has feature, sample, w."""
    if randomization not in ("features", "abundances"):
        raise ValueError("randomization is features or abundances")
    if n < 1:
        raise ValueError("one iteration or more")
    spark, within = w.sparkSession, randomization == "abundances"
    schema = SAMPLES if own else PAIRS
    w = settled(w.where("feature is not null and sample is not null").select(F.col("feature").cast("string").alias("feature"), F.col("sample").cast("string").alias("sample"), F.col("w").cast("double").alias("w")))
    features = numbered(w.select("feature").distinct(), "code", "feature").select("feature", (F.col("code") - 1).cast("int").alias("code"))
    size = w.agg(F.countDistinct("feature").alias("f"), F.countDistinct("sample").alias("s")).first()
    wide, many = size["f"], size["s"]
    if wide > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features: use arrays=False")
    if not wide:
        return spark.createDataFrame([], schema)
    block = max(1, min(block, WEIGHTS // wide))
    blocks, high = -(-many // block), max(1, cells // wide)
    parts = -(-wide // high)
    row = (1 if own else min(block, many)) * min(block, many) * (2 if sums is mean_nearest else 1)
    # Values of a chunk are one row; moments do not grow with the chunk.
    chunk = max(1, min(n, numbers // row)) if parts > 1 else max(1, min(n, 64))
    chunks = -(-n // chunk)
    tiles = blocks if own else blocks * (blocks + 1) // 2
    spans = max(1, min(chunks, -(-2 * spark.sparkContext.defaultParallelism // (tiles * parts))))

    placed = numbered(w.select("sample").distinct(), "place", "sample").select("sample", F.expr(f"cast((place - 1) div {block} as int)").alias("block"))
    held = settled(w.join(features, "feature").join(placed, "sample").groupBy("block").agg(F.collect_list(F.struct("code", "sample", "w")).alias("rows")))
    to = F.array("block") if own else F.sequence("block", F.lit(blocks - 1))
    tile = held.select(F.col("block").alias("a"), F.col("rows").alias("one"), F.explode(to).alias("b"))
    other = held.select(F.col("block").alias("b"), (F.array().cast("array<struct<code:int,sample:string,w:double>>") if own else F.col("rows")).alias("two"))
    i, j = features.select(F.col("feature").alias("f1"), F.col("code").alias("i")), features.select(F.col("feature").alias("f2"), F.col("code").alias("j"))
    known = distmat.where("d is not null").join(i, "f1").join(j, "f2").select(F.expr(f"i div {high}").cast("int").alias("part"), F.struct("i", "j", F.col("d").cast("double").alias("d")).alias("cell"))
    # A part without any distance is there too, so that its samples are.
    every = spark.range(parts).select(F.col("id").cast("int").alias("part"))
    matrix = every.join(known, "part", "left").groupBy("part").agg(F.collect_list("cell").alias("d"))
    names = features.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "feature"))), lambda x: x["feature"]).alias("names"))
    span = F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))
    work = tile.join(other, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(matrix, "part").withColumn("span", span)
    bound = lambda k: F.expr(f"cast(({k}) * {chunks} div {spans} as int)")
    work = work.select("a", "b", "part", "one", "two", "d", bound("span").alias("begin"), bound("span + 1").alias("end"), F.lit(chunk).alias("size"))
    # One row of names, of a checked number.
    work = work.repartition(tiles * parts * spans, "a", "b", "part", "begin").join(F.broadcast(names))
    out = work.mapInArrow(_spans(sums, own, seed, n, within, high, parts == 1, conspecifics), PART)
    if parts > 1:
        out = out.repartition("a", "b", "chunk").sortWithinPartitions("a", "b", "chunk", "part").mapInArrow(_whole_values(2 if sums is mean_nearest else 1, own), PART)
    return out.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInArrow(summaries(own), schema)
