"""Whitening of embeddings by the eigenvectors of their covariance.

An entry c becomes the long x = floor(256 c). The covariance is that of the
distinct x vectors, each once. Sums are exact: a row is centred as the long
n x - S, and only then becomes a double. Spark's RowMatrix gives the Gramian of
the centred rows; divided by n it is the covariance, whose eigenvectors come
from numpy on the driver, where it has d x d entries and no more. The whitening
matrix, d x components, travels with the tasks that apply it.

Defined cases: vectors that are null or hold null or non-finite entries take no
part. A vector shorter than the longest is filled with zeros, so that no row is
lost. Repeated rows and repeated or null ids are rows of their own. An entry
whose floor passes 64 bits stops at their limits; a deviation that does is null.
Where a component has no variance (its share is below d times a double's
rounding), whitened is null; explained is null if there is no variance at all.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, COMPONENTS = 256, 4
_FAR = 1 << 62


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x: the vectors that take part, as longs."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    whole = lambda e: F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(9.2e18)), F.lit(-9.2e18)))
    return df.where(v.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), F.transform(v, whole).alias("x"))


def _rows(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack(vectors.to_list()) if len(vectors) else np.zeros((0, width), dtype=np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: in 64 bits where these suffice, else as Python's own
    whole numbers."""
    if x.size == 0 or max(abs(int(x.min())), abs(int(x.max()))) * n + max(map(abs, sums.tolist()), default=0) < _FAR:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _squares(centred: np.ndarray) -> list[int | None]:
    """Sums of squares, exactly; null beyond 64 bits."""
    if not centred.size:
        return [0] * len(centred)
    if centred.dtype != object and float(np.abs(centred).max()) ** 2 * centred.shape[1] < _FAR:
        return (centred * centred).sum(axis=1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in centred]
    return [s if s < 1 << 63 else None for s in sums]


@dataclass(frozen=True)
class Whitening:
    """``sums`` and ``n`` centre a row; ``matrix`` (d x components) whitens it."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float
    components: int

    @property
    def defined(self) -> np.ndarray:
        """Which of the components have variance."""
        e = self.eigenvalues[: self.components]
        return e > max(self.trace, 0) * len(self.sums) * np.finfo(float).eps

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where a component has no variance."""
        e = np.where(self.defined, self.eigenvalues[: self.components], np.nan)
        return (centred / self.n).astype(np.float64) @ self.vectors[:, : self.components] / np.sqrt(e)


def _totals(distinct: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Rows and exact sums by dimension; tasks hand over a row a dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _rows(batch["x"], d)
            small = x.size == 0 or max(abs(int(x.min())), abs(int(x.max()))) * len(x) < _FAR
            sums = [a + b for a, b in zip(sums, (x if small else x.astype(object)).sum(axis=0).tolist(), strict=True)]
            n += len(batch)
        yield pd.DataFrame({"dimension": range(-1, d), "part": [str(v) for v in (n, *sums)]})

    parts = distinct.mapInPandas(run, "dimension int, part string")
    got = {r["dimension"]: int(r["total"]) for r in parts.groupBy("dimension").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(d)], dtype=object)


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``distinct`` (x, of d entries), each row of which counts
    once; there is one at least."""
    n, sums = _totals(distinct, d)

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": list((_centred(_rows(batch["x"], d), n, sums) / n).astype(np.float64))})

    rows = distinct.select("x").mapInPandas(centre, "x array<double>").select(array_to_vector("x").alias("x"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "x"), n, d).computeGramianMatrix().toArray()
    cov = (gram + gram.T) / 2 / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, sums, values[order], vectors[:, order], float(np.trace(cov)), min(components, d))


def identity_error(distinct: DataFrame, w: Whitening) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity,
    measured on the rows; over the components that have variance."""
    ok = w.defined
    if not ok.any():
        return None
    d = len(w.sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y = w.apply(_centred(_rows(batch["x"], d), w.n, w.sums))[:, ok]
            yield pd.DataFrame({"sums": [y.sum(axis=0)], "squares": [(y.T @ y).ravel()]})

    k = int(ok.sum())
    parts = distinct.select("x").mapInPandas(run, "sums array<double>, squares array<double>")
    totals = parts.select(F.posexplode(F.concat("sums", "squares")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in totals:
        flat[r["at"]] = r["v"]
    mean, second = flat[:k] / w.n, flat[k:].reshape(k, k) / w.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, n, deviation, whitened, explained (arrays, one entry a component)
    and identity_error, for each row that takes part."""
    x = scaled(df, id_col, vector_col, scale)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    widest = x.agg(F.max(F.size("x"))).first()[0]
    if not widest:
        return df.sparkSession.createDataFrame([], schema)
    filled = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(widest) - F.size("x"))))
    distinct = cut(filled.select("x").distinct())
    w = fit(distinct, widest, components)
    error = identity_error(distinct, w)
    explained = [float(e) / w.trace if w.trace > 0 else None for e in w.eigenvalues[: w.components]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centred = _centred(_rows(batch["x"], widest), w.n, w.sums)
            y = [[None if np.isnan(v) else v for v in row] for row in w.apply(centred).tolist()]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "n": w.n, "deviation": pd.array(_squares(centred), dtype="Int64"), "whitened": y, "explained": [explained] * len(y), "identity_error": error})

    return filled.select(F.col("vec_id").cast("string").alias("vec_id"), "x").mapInPandas(run, schema.replace("vec_id long", "vec_id string")).withColumn("vec_id", F.col("vec_id").cast("long"))
