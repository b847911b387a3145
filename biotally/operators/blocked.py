"""Ordination and permutation tests on a matrix of samples kept in blocks.

The matrix -d^2/2 stays distributed as square blocks of its upper half; a task
has one block and thin strips of the vectors it meets. Nothing of one number a
sample and more comes to the driver but a design's Gram matrix (columns x
columns), so that samples are not limited as they are in ``ordination``.

Sums of squares need no hat matrix: tr(H G) is the sum of q' A q over a basis q
of the model, and double centring falls away, as such q sum to zero. A
permutation permutes the rows of the basis, and the bases of many permutations
stand side by side as one thin matrix, which meets each block once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import key
from . import pairwise
from .relational import numbered, settled

#: Samples of a block: 8 MB of numbers.
BLOCK = 1024
#: Vectors that meet a block together.
WIDTH = 256
#: Columns of a design at most.
COLUMNS = 512


@dataclass(frozen=True)
class Blocks:
    """samples: sample, at from 0. packed: i <= j, data (rows of block i by rows of
    block j, as doubles, compressed), of -value^2 / 2. grand: their mean over all
    n x n."""

    samples: DataFrame
    packed: DataFrame
    n: int
    size: int
    grand: float

    def rows(self, block: int) -> int:
        return min(self.size, self.n - block * self.size)

    @property
    def cells(self) -> DataFrame:
        """``packed`` as plain doubles."""
        n, size = self.n, self.size

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, j, data in pdf[["i", "j", "data"]].itertuples(index=False):
                    x = _block(data, min(size, n - i * size), min(size, n - j * size))
                    yield pd.DataFrame({"i": [i], "j": [j], "data": [x.tobytes()]})

        return self.packed.mapInPandas(run, "i int, j int, data binary")


def _compressed(x: np.ndarray) -> bytes:
    """Pairs that share nothing are all alike, and take next to nothing."""
    return pa.compress(np.ascontiguousarray(x, dtype=float).tobytes(), codec="zstd", asbytes=True)


def _block(data: bytes, rows: int, cols: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, rows * cols * 8, codec="zstd", asbytes=True), dtype=float).reshape(rows, cols)


def blocked(pairs: DataFrame | pairwise.Pairs, size: int | None = None) -> Blocks:
    """``pairs`` (s1 < s2, value) in blocks; pairs that are missing are 0. Blocks
    of ``pairwise.Pairs`` are made without a row a pair."""
    size = size or BLOCK
    if isinstance(pairs, pairwise.Pairs):
        tab, kinds = pairs.tab.where("value > 0 and sample is not null"), dict(pairs.tab.dtypes)
        each = settled(tab.groupBy("sample").agg(F.count(F.lit(1)).alias("cells")))
        if kinds["sample"] == kinds["feature"] == "string" and (each.agg(F.max("cells")).first()[0] or pairwise.MOST_CELLS + 1) <= pairwise.MOST_CELLS:
            samples = settled(numbered(each.select("sample"), "at", "sample").select("sample", (F.col("at") - 1).alias("at")))
            n = samples.count()
            made = settled(pairwise.matrix(pairs, samples, n, size, _compressed))
            return Blocks(samples, made.drop("total"), n, size, made.agg(F.sum("total")).first()[0] / (n * n))
        pairs = pairs.rows(pairs.tab)
    names = pairs.select(F.explode(F.array("s1", "s2")).alias("sample")).distinct()
    samples = settled(numbered(names, "at", "sample").select("sample", (F.col("at") - 1).alias("at")))
    n = samples.count()
    one, two = samples.toDF("s1", "a1"), samples.toDF("s2", "a2")
    met = pairs.join(one, "s1").join(two, "s2").select("a1", "a2", (F.col("value") * F.col("value") * -0.5).alias("v"))
    # Names are in order, so that a1 < a2; within a block on the diagonal the other half is the same.
    cells = met.select(F.floor(F.col("a1") / size).cast("int").alias("i"), F.floor(F.col("a2") / size).cast("int").alias("j"), (F.col("a1") % size).cast("int").alias("r"), (F.col("a2") % size).cast("int").alias("c"), "v")

    def dense(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = keys
        out = np.zeros((min(size, n - i * size), min(size, n - j * size)))
        out[pdf["r"], pdf["c"]] = pdf["v"]
        if i == j:
            out[pdf["c"], pdf["r"]] = pdf["v"]
        return pd.DataFrame({"i": [i], "j": [j], "data": [_compressed(out)], "total": [out.sum() * (1 if i == j else 2)]})

    made = settled(cells.groupBy("i", "j").applyInPandas(dense, "i int, j int, data binary, total double"))
    total = made.agg(F.sum("total")).first()[0] or 0.0
    return Blocks(samples, made.drop("total"), n, size, total / (n * n) if n else 0.0)


def _matrix(data, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=float).reshape(rows, -1)


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays (data) added up by their keys, one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for *k, data in pdf[[*keys, "data"]].itertuples(index=False):
                x = np.frombuffer(data, dtype=float)
                sums[tuple(k)] = sums[tuple(k)] + x if tuple(k) in sums else x
        for k, x in sums.items():
            yield pd.DataFrame([[*k, x.tobytes()]], columns=[*keys, "data"])

    return parts.repartition(*keys).mapInPandas(run, ", ".join(f"{k} int" for k in keys) + ", data binary")


def times(m: Blocks, x: DataFrame) -> DataFrame:
    """b, data: the matrix by a thin one (b, data: its rows of a block)."""
    n, size = m.n, m.size
    met = m.packed.join(x.select(F.col("b").alias("i"), F.col("data").alias("xi")), "i").join(x.select(F.col("b").alias("j"), F.col("data").alias("xj")), "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, np.ndarray] = {}
            for r in batch.to_pylist():
                i, j = r["i"], r["j"]
                rows, cols = min(size, n - i * size), min(size, n - j * size)
                a = _block(r["data"], rows, cols)
                both = [(i, a @ _matrix(r["xj"], cols))] + ([(j, a.T @ _matrix(r["xi"], rows))] if i != j else [])
                for b, y in both:
                    out[b] = out[b] + y if b in out else y
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([y.tobytes() for y in out.values()], pa.binary())], names=["b", "data"])

    return _summed(met.select("i", "j", "data", "xi", "xj").mapInArrow(run, "b int, data binary"), ["b"])


def _each(x: DataFrame, m: Blocks, function) -> DataFrame:
    """b, data with ``function(block number, rows)`` of each strip."""
    n, size = m.n, m.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["b"], "data": [np.ascontiguousarray(function(b, _matrix(d, min(size, n - b * size)))).tobytes() for b, d in zip(pdf["b"], pdf["data"], strict=True)]})

    return x.mapInPandas(run, "b int, data binary")


def _gram(x: DataFrame, m: Blocks, y: DataFrame | None = None) -> np.ndarray:
    """x' y, a small matrix."""
    n, size = m.n, m.size
    met = x.select("b", "data", F.col("data").alias("other")) if y is None else x.join(y.select("b", F.col("data").alias("other")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for b, one, two in pdf[["b", "data", "other"]].itertuples(index=False):
                rows = min(size, n - b * size)
                own = _matrix(one, rows).T @ _matrix(two, rows)
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"k": [0], "data": [total.tobytes()], "width": [total.shape[1]]})

    parts = met.select("b", "data", "other").mapInPandas(run, "k int, data binary, width int").collect()
    return sum(np.frombuffer(r["data"], dtype=float).reshape(-1, r["width"]) for r in parts) if parts else np.zeros((0, 0))


def _orthonormal(x: DataFrame, m: Blocks) -> DataFrame:
    """A basis of x's columns, twice made orthonormal by its Gram matrix."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(_gram(x, m))
        kept = values > 1e-14 * max(values.max(initial=0.0), 1e-300)
        turn = vectors[:, kept] / np.sqrt(values[kept])
        x = settled(_each(x, m, lambda _, rows, turn=turn: rows @ turn))
    return x


def _centred_times(m: Blocks, x: DataFrame, means: DataFrame) -> DataFrame:
    """The doubly centred matrix by x, whose columns sum to zero: A x less its
    column means, as the rest of the centring falls away."""
    y = settled(times(m, x))
    total = _gram(means, m, y)[:1] / m.n  # of a column of ones
    return settled(_each(y, m, lambda _, rows: rows - total))


def pcoa(pairs: DataFrame | pairwise.Pairs, axes: int = 10, more: int = 10, passes: int = 4, seed: int = 0, size: int | None = None) -> DataFrame:
    """sample, axis, score, eigenvalue, percent (of the trace) of the ``axes``
    first axes with positive eigenvalues.

    A randomized range finder: random vectors go through the centred matrix
    ``passes`` times, made orthonormal each time; the matrix on their span,
    ``axes + more`` square, gives the axes. Vectors are drawn by block."""
    m = blocked(pairs, size)
    schema = "sample string, axis int, score double, eigenvalue double, percent double"
    if m.n < 2:
        return pairs.sparkSession.createDataFrame([], schema)
    n, size, k = m.n, m.size, min(axes + more, m.n)
    numbers = settled(m.samples.select(F.floor(F.col("at") / size).cast("int").alias("b")).distinct())

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["b"], "data": [np.random.default_rng([seed, int(b)]).standard_normal((min(size, n - b * size), k)).tobytes() for b in pdf["b"]]})

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"b": pdf["b"], "data": [np.ones(min(size, n - b * size)).tobytes() for b in pdf["b"]]})

    one = settled(numbers.mapInPandas(ones, "b int, data binary"))

    def centred(x: DataFrame) -> DataFrame:
        mean = _gram(one, m, x)[:1] / n
        return settled(_each(x, m, lambda _, rows: rows - mean))

    q = _orthonormal(centred(settled(numbers.mapInPandas(drawn, "b int, data binary"))), m)
    for _ in range(passes):
        q = _orthonormal(centred(_centred_times(m, q, one)), m)
    small = _gram(q, m, _centred_times(m, q, one))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:axes]
    order = order[values[order] > 1e-10]
    values, turn = values[order], vectors[:, order] * np.sqrt(values[order])
    trace = -n * m.grand
    scores = settled(_each(q, m, lambda _, rows: rows @ turn))
    if not len(values):
        return pairs.sparkSession.createDataFrame([], schema)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, data in zip(pdf["b"], pdf["data"], strict=True):
                rows = _matrix(data, min(size, n - b * size))
                at, axis = np.indices(rows.shape)
                axis = axis.ravel()
                yield pd.DataFrame({"at": at.ravel() + int(b) * size, "axis": axis + 1, "score": rows.ravel(), "eigenvalue": values[axis], "percent": np.round(100 * values[axis] / trace, 2)})

    rows = scores.mapInPandas(listed, "at long, axis int, score double, eigenvalue double, percent double")
    return rows.join(m.samples, "at").select("sample", "axis", "score", "eigenvalue", "percent")


# -- permutation tests ------------------------------------------------------------


def encoded(meta: DataFrame, by: Sequence[str], interactions: Sequence[tuple[str, str]] = ()) -> tuple[DataFrame, dict[str, list[int]]]:
    """(sample, x) and the columns of each term: centred numbers, dummies of
    sorted levels (but the first), and products for interactions."""
    kinds = dict(meta.dtypes)
    raw: list[tuple[str, Column]] = []
    terms: dict[str, list[int]] = {}
    for c in by:
        if kinds[c].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
            own = [F.col(c).cast("double")]
        else:
            levels = [r[0] for r in meta.select(F.col(c).cast("string")).distinct().sort(c).limit(COLUMNS + 1).collect()]
            own = [F.col(c).cast("string").eqNullSafe(v).cast("double") for v in levels[1:]]
        terms[c] = list(range(len(raw), len(raw) + len(own)))
        raw += [(c, x) for x in own]
        if len(raw) > COLUMNS:
            raise ValueError(f"more than {COLUMNS} columns of a design")
    rows = meta.select("sample", F.array(*[x for _, x in raw]).cast("array<double>").alias("x"))
    rows = _less_means(rows, len(raw))
    products = []
    for a, b in interactions:
        terms[f"{a}:{b}"] = list(range(len(raw) + len(products), len(raw) + len(products) + len(terms[a]) * len(terms[b])))
        products += [F.col("x")[i] * F.col("x")[j] for i in terms[a] for j in terms[b]]
    if products:
        rows = _less_means(rows.select("sample", F.concat("x", F.array(*products)).alias("x")), len(raw) + len(products))
    return rows, terms


def _less_means(rows: DataFrame, width: int) -> DataFrame:
    if not width:
        return rows
    means = rows.agg(*[F.avg(F.col("x")[k]) for k in range(width)]).first()
    return rows.select("sample", F.zip_with("x", F.array(*[F.lit(float(v or 0.0)) for v in means]), lambda x, v: x - v).alias("x"))


def _basis(s: np.ndarray, cols: list[int]) -> np.ndarray:
    """Coefficients that make the columns orthonormal, given their Gram matrix."""
    out = np.zeros((len(s), 0))
    if not cols:
        return out
    values, vectors = np.linalg.eigh(s[np.ix_(cols, cols)])
    kept = values > 1e-10 * max(values.max(), 1e-300)
    out = np.zeros((len(s), int(kept.sum())))
    out[cols] = vectors[:, kept] / np.sqrt(values[kept])
    return out


def relabelled(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """it, sample, to: permutations of the ids within their strata (sample, stratum)."""
    rows = ids.join(ids.sparkSession.range(1, n + 1).select(F.col("id").alias("it")))
    of = ("it", "stratum")
    place = rows.select(*of, "sample", F.row_number().over(Window.partitionBy(*of).orderBy("sample")).alias("k"))
    drawn = rows.select(*of, F.col("sample").alias("to"), F.row_number().over(Window.partitionBy(*of).orderBy(key(F.lit(seed), "it", "sample"), "sample")).alias("k"))
    return place.join(drawn, [*of, "k"]).select("it", "sample", "to")


def _quadratic(m: Blocks, z: DataFrame) -> DataFrame:
    """c, data: z' A z by column, for each set c of columns (b, c, data)."""
    n, size = m.n, m.size
    met = m.packed.join(z.select(F.col("b").alias("i"), "c", F.col("data").alias("zi")), "i").join(z.select(F.col("b").alias("j"), "c", F.col("data").alias("zj")), ["j", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(1))
        for batch in batches:
            for r in batch.to_pylist():
                rows, cols = min(size, n - r["i"] * size), min(size, n - r["j"] * size)
                own = (_matrix(r["zi"], rows) * (_block(r["data"], rows, cols) @ _matrix(r["zj"], cols))).sum(axis=0)
                sums[r["c"]] = sums[r["c"]] + own * (1 if r["i"] == r["j"] else 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["c", "data"])

    return _summed(met.select("i", "j", "c", "data", "zi", "zj").mapInArrow(run, "c int, data binary"), ["c"])


def permanova(pairs: DataFrame | pairwise.Pairs, meta: DataFrame, by: Sequence[str] | str, n: int = 999, seed: int = 0, include_interaction: bool = False, strata: str | None = None, scheme: str = "labels", size: int | None = None) -> DataFrame:
    """term, df, ss, ms, f, r2, p as ``ordination.permanova`` has them, for any
    number of samples: marginal sums of squares; labels are permuted, within
    strata if named, or (freedman-lane) the residuals of the model without the
    term, whose basis the permuted one is then freed of."""
    if scheme not in ("labels", "freedman-lane"):
        raise ValueError("scheme is labels or freedman-lane")
    by = [by] if isinstance(by, str) else list(by)
    spark = pairs.sparkSession
    m = blocked(pairs, size)
    kept = meta.join(m.samples, "sample")
    x, terms = encoded(kept, by, [(by[0], by[1])] if include_interaction and len(by) == 2 else ())
    x = settled(x.join(m.samples, "sample"))
    width = sum(map(len, terms.values()))
    products = x.select(F.posexplode("x").alias("k", "v"), "x").select("k", F.transform("x", lambda e: e * F.col("v")).alias("x"))
    sums = products.groupBy("k").agg(*[F.sum(F.col("x")[i]) for i in range(width)]).collect() if width else []
    s = np.zeros((width, width))
    for r in sums:  # a row a column of the design
        s[r["k"]] = list(r)[1:]
    full = _basis(s, list(range(width)))
    rank, total = full.shape[1], -m.n * m.grand
    # A term's basis: what the full model has beyond the one without the term.
    reduced, own = {}, {}
    for t, cols in terms.items():
        reduced[t] = _basis(s, [k for k in range(width) if k not in cols])
        _, values, vt = np.linalg.svd(reduced[t].T @ s @ full, full_matrices=True)
        own[t] = full @ vt[int(np.sum(values > 1e-8)) :].T
    df = {t: w.shape[1] for t, w in own.items()}
    df_res = m.n - 1 - rank
    free = scheme == "freedman-lane"
    # Columns of one permutation: the model's and each term's, or for each term the pair.
    stack = np.hstack([w for t in terms for w in (reduced[t], own[t])] if free else [full, *[own[t] for t in terms]])
    stack = stack if stack.shape[1] else np.zeros((width, 1))
    each = stack.shape[1]
    per = max(1, WIDTH // each)
    moves = x.select(F.lit(0).cast("long").alias("it"), "sample", F.col("sample").alias("to"))
    if n:
        ids = (kept.select("sample", F.col(strata).cast("string").alias("stratum")) if strata else m.samples.select("sample", F.lit("").alias("stratum"))).na.fill("", ["stratum"])
        moves = moves.unionByName(relabelled(ids, n, seed))
    placed = moves.join(x.select(F.col("sample").alias("to"), "x"), "to").join(m.samples, "sample")
    block, rows_of = m.size, m.n
    placed = placed.select(F.floor(F.col("at") / block).cast("int").alias("b"), F.floor(F.col("it") / per).cast("int").alias("c"), (F.col("at") % block).cast("int").alias("r"), (F.col("it") % per).cast("int").alias("k"), "x")

    def strip(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b, c = keys
        out = np.zeros((min(block, rows_of - b * block), min(per, n + 1 - c * per) * each))
        w = np.stack(pdf["x"].to_list()) @ stack
        out[pdf["r"].to_numpy()[:, None], pdf["k"].to_numpy()[:, None] * each + np.arange(each)] = w
        return pd.DataFrame({"b": [b], "c": [c], "data": [out.tobytes()]})

    z = settled(placed.groupBy("b", "c").applyInPandas(strip, "b int, c int, data binary"))
    if free:
        z = settled(_freed(z, m, x, reduced, own, terms, each))
    found = {}
    for r in _quadratic(m, z).toLocalIterator():
        for k, v in enumerate(np.frombuffer(r["data"], dtype=float).reshape(-1, each)):
            found[r["c"] * per + k] = v
    table = np.array([found[k] for k in range(n + 1)]) if found else np.zeros((n + 1, each))

    def statistics(t: str) -> tuple[np.ndarray, np.ndarray]:
        """ss of the term and of the residuals, by permutation."""
        if free:
            start = sum(reduced[o].shape[1] + df[o] for o in list(terms)[: list(terms).index(t)])
            mid = start + reduced[t].shape[1]
            return table[:, mid : mid + df[t]].sum(axis=1), total - table[:, start : mid + df[t]].sum(axis=1) - np.where(np.arange(n + 1) > 0, observed_reduced[t], 0.0)
        start = rank + sum(df[o] for o in list(terms)[: list(terms).index(t)])
        return table[:, start : start + df[t]].sum(axis=1), total - table[:, :rank].sum(axis=1)

    observed_reduced = {}
    if free:
        at = 0
        for t in terms:
            observed_reduced[t] = table[0, at : at + reduced[t].shape[1]].sum()
            at += reduced[t].shape[1] + df[t]
    out = []
    rest = None
    for t in terms:
        ss, res = statistics(t)
        rest = float(res[0])
        ok = df[t] and df_res and rest > 1e-12
        f = (ss / df[t]) / (res / df_res) if df[t] and df_res else np.full(n + 1, np.nan)
        p = None
        if n and ok and not (n > 1 and np.ptp(np.round(f[1:], 12)) == 0):
            p = float((np.sum(np.round(f[1:], 10) >= round(float(f[0]), 10)) + 1) / (n + 1))
        out.append((t, float(df[t]), float(ss[0]), float(ss[0]) / df[t] if df[t] else None, float(f[0]) if ok else None, float(ss[0]) / total if total else None, p))
    rest = float(total) if rest is None else rest
    out.append(("Residual", float(df_res), rest, rest / df_res if df_res else None, None, rest / total if total else None, None))
    return spark.createDataFrame(out, "term string, df double, ss double, ms double, f double, r2 double, p double")


def _freed(z: DataFrame, m: Blocks, x: DataFrame, reduced: dict, own: dict, terms: dict, each: int) -> DataFrame:
    """Permuted bases less their part in the model without the term. The first
    permutation is none: it stays as it is."""
    n, size = m.n, m.size
    block = F.floor(F.col("at") / size).cast("int")
    rows = x.select(block.alias("b"), (F.col("at") % size).cast("int").alias("r"), "x")

    def thick(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        (b,) = keys
        out = np.zeros((min(size, n - b * size), len(pdf["x"].iloc[0])))
        out[pdf["r"]] = np.stack(pdf["x"].to_list())
        return pd.DataFrame({"b": [b], "data": [out.tobytes()]})

    design = settled(rows.groupBy("b").applyInPandas(thick, "b int, data binary"))
    spans, at = [], 0
    for t in terms:
        spans.append((at, at + reduced[t].shape[1] + own[t].shape[1], reduced[t]))
        at = spans[-1][1]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c, data, xs in pdf[["b", "c", "data", "xs"]].itertuples(index=False):
                count = min(size, n - b * size)
                strip, model = _matrix(data, count), _matrix(xs, count)
                yield pd.DataFrame({"c": [c], "data": [(model.T @ strip).tobytes()]})

    met = z.join(design.select("b", F.col("data").alias("xs")), "b")
    # x' z of a set of permutations: columns of the design by columns of the set.
    crossed = _summed(met.select("b", "c", "data", "xs").mapInPandas(parts, "c int, data binary"), ["c"])

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c, data, xs, cross in pdf[["b", "c", "data", "xs", "cross"]].itertuples(index=False):
                count = min(size, n - b * size)
                strip, model = _matrix(data, count).copy(), _matrix(xs, count)
                xz = _matrix(cross, model.shape[1])
                for k in range(strip.shape[1] // each):
                    if c == 0 and k == 0:
                        continue
                    for lo, hi, basis in spans:
                        cols = slice(k * each + lo, k * each + hi)
                        strip[:, cols] -= model @ (basis @ (basis.T @ xz[:, cols]))
                yield pd.DataFrame({"b": [b], "c": [c], "data": [strip.tobytes()]})

    both = met.join(crossed.select("c", F.col("data").alias("cross")), "c")
    return both.select("b", "c", "data", "xs", "cross").mapInPandas(free, "b int, c int, data binary")
