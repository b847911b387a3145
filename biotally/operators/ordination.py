"""Ordination and permutation tests on a square matrix of samples.

Distances come distributed; what follows is dense algebra on one row and column
a sample, done on the driver up to ``MOST`` samples (a bound that is checked).
Permutations run on the cluster with the matrices in their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .statistics import both_ways

MOST = 5000


def square(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Pairs (s1 < s2, value) as names in order and a symmetric matrix."""
    names = [r[0] for r in pairs.select(F.explode(F.array("s1", "s2")).alias("s")).distinct().orderBy("s").limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} samples: too many for dense algebra")
    rows = pairs.select("s1", "s2", "value").toPandas()
    at = {s: k for k, s in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    i, j = rows["s1"].map(at).to_numpy(), rows["s2"].map(at).to_numpy()
    out[i, j] = out[j, i] = rows["value"].to_numpy(dtype=float)
    return names, out


def double_center(pairs: DataFrame) -> DataFrame:
    """s1, s2, a: -d^2/2 less row and column means, for all ordered pairs."""
    samples = pairs.select(F.explode(F.array("s1", "s2")).alias("s")).distinct()
    full = both_ways(pairs).unionByName(samples.select(F.col("s").alias("s1"), F.col("s").alias("s2"), F.lit(0.0).alias("value"))).select("s1", "s2", (F.col("value") * F.col("value") * -0.5).alias("a"))
    means = full.groupBy("s1").agg(F.avg("a").alias("m"))
    grand = full.agg(F.avg("a").alias("g"))
    two = means.select(F.col("s1").alias("s2"), F.col("m").alias("m2"))
    return full.join(means, "s1").join(two, "s2").join(F.broadcast(grand)).select("s1", "s2", (F.col("a") - F.col("m") - F.col("m2") + F.col("g")).alias("a"))


@dataclass
class Ordination:
    names: list[str]
    values: np.ndarray  # eigenvalues kept
    scores: np.ndarray  # samples x axes
    percent: np.ndarray


def _signed(v: np.ndarray) -> np.ndarray:
    """Axes turned so that their largest entry is positive."""
    top = v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] if v.size else np.ones(v.shape[1])
    return v * np.where(top < 0, -1.0, 1.0)


def _centered(d: np.ndarray) -> np.ndarray:
    a = -0.5 * d * d
    return a - a.mean(axis=0) - a.mean(axis=1)[:, None] + a.mean()


def pcoa_matrix(names: list[str], d: np.ndarray, correction: str = "none", tol: float = 1e-10) -> Ordination:
    d = (d + d.T) / 2
    values, vectors = np.linalg.eigh(_centered(d))
    if correction == "lingoes" and values.min() < -tol:
        d2 = d * d + 2 * abs(values.min())
        np.fill_diagonal(d2, 0.0)
        values, vectors = np.linalg.eigh(_centered(np.sqrt(d2)))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    keep = values > tol
    values, vectors = values[keep], _signed(vectors[:, keep])
    return Ordination(names, values, vectors * np.sqrt(values), np.round(100 * values / values.sum(), 2) if len(values) else values)


def pcoa(pairs: DataFrame, correction: str = "none") -> DataFrame:
    """sample, axis, score, eigenvalue, percent. ``correction`` 'lingoes' lifts
    distances so that no axis is imaginary; 'none' drops such axes."""
    o = pcoa_matrix(*square(pairs), correction=correction)
    rows = [(s, k + 1, float(o.scores[i, k]), float(o.values[k]), float(o.percent[k])) for i, s in enumerate(o.names) for k in range(len(o.values))]
    return pairs.sparkSession.createDataFrame(rows, "sample string, axis int, score double, eigenvalue double, percent double")


# -- designs ----------------------------------------------------------------------


def design(meta: pd.DataFrame, by: Sequence[str], interactions: Sequence[tuple[str, str]] = (), drop_first: bool = True) -> tuple[np.ndarray, list[str], dict[str, list[int]]]:
    """Centred numbers and dummies of sorted levels (but the first), products for
    interactions -> matrix, column names, columns of each term."""
    cols: list[np.ndarray] = []
    names: list[str] = []
    terms: dict[str, list[int]] = {}
    for c in by:
        terms[c] = []
        if pd.api.types.is_numeric_dtype(meta[c]) and not pd.api.types.is_bool_dtype(meta[c]):
            block = [(c, meta[c].to_numpy(dtype=float))]
        else:
            levels = sorted(meta[c].astype(str).unique())[1 if drop_first else 0 :]
            block = [(f"{c}={v}", (meta[c].astype(str) == v).to_numpy(dtype=float)) for v in levels]
        for name, x in block:
            terms[c].append(len(cols))
            cols.append(x - x.mean())
            names.append(name)
    for a, b in interactions:
        terms[f"{a}:{b}"] = []
        for i in terms[a]:
            for j in terms[b]:
                x = cols[i] * cols[j]
                terms[f"{a}:{b}"].append(len(cols))
                cols.append(x - x.mean())
                names.append(f"{names[i]}:{names[j]}")
    return (np.stack(cols, axis=1) if cols else np.zeros((len(meta), 0))), names, terms


def hat(x: np.ndarray) -> np.ndarray:
    if not x.shape[1]:
        return np.zeros((len(x), len(x)))
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-10 * max(1.0, s.max())]
    return u @ u.T


def meta_frame(meta: DataFrame, names: list[str], by: Sequence[str]) -> pd.DataFrame:
    return meta.select("sample", *dict.fromkeys(by)).toPandas().set_index("sample").loc[names]


def permuted_rows(it: int, n: int, seed: int, strata: np.ndarray | None = None) -> np.ndarray:
    """A permutation that depends on its number alone; within strata, if given."""
    rng = np.random.default_rng([seed, it])
    if strata is None:
        return rng.permutation(n)
    out = np.arange(n)
    for s in np.unique(strata):
        at = np.flatnonzero(strata == s)
        out[at] = at[rng.permutation(len(at))]
    return out


def _null(spark, n: int, statistic, width: int) -> np.ndarray:
    """statistic(it) -> row of numbers, for it 1 to n, on the cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([[int(i), *statistic(int(i))] for i in pdf["id"]], columns=["it", *[f"v{k}" for k in range(width)]])

    rows = spark.range(1, n + 1).mapInPandas(run, "it long, " + ", ".join(f"v{k} double" for k in range(width)))
    return rows.toPandas().sort_values("it").drop(columns="it").to_numpy()


def _p(null: np.ndarray, observed: float) -> float | None:
    if np.isnan(observed) or not len(null) or (len(null) > 1 and np.ptp(np.round(null, 12)) == 0):
        return None
    return float((np.sum(np.round(null, 10) >= round(observed, 10)) + 1) / (len(null) + 1))


def permanova(pairs: DataFrame, meta: DataFrame, by: Sequence[str] | str, n: int = 999, seed: int = 0, include_interaction: bool = False, strata: str | None = None, scheme: str = "labels") -> DataFrame:
    """term, df, ss, ms, f, r2, p: marginal sums of squares of one or two factors
    (and their interaction). Labels are permuted, within strata if named, or,
    by 'freedman-lane', the residuals of the model without the term."""
    by = [by] if isinstance(by, str) else list(by)
    names, d = square(pairs)
    m = meta_frame(meta, names, [*by, *([strata] if strata else [])])
    x, _, terms = design(m, by, [(by[0], by[1])] if include_interaction and len(by) == 2 else ())
    a, size = _centered(d), len(names)
    total, full = float(np.trace(a)), hat(x)
    rank = int(round(np.trace(full)))
    reduced = {t: hat(np.delete(x, cols, axis=1)) for t, cols in terms.items()}
    df = {t: rank - int(round(np.trace(h))) for t, h in reduced.items()}
    df_res = size - 1 - rank
    block = m[strata].astype(str).to_numpy() if strata else None
    eye = np.eye(size)

    def fs(g: np.ndarray, t: str) -> float:
        ss = float(np.sum((full - reduced[t]) * g))
        rest = float(np.trace(g) - np.sum(full * g))
        return (ss / df[t]) / (rest / df_res) if df[t] and df_res and rest > 1e-12 else float("nan")

    def statistic(it: int) -> list[float]:
        p = permuted_rows(it, size, seed, block)
        out = []
        for t in terms:
            if scheme == "freedman-lane":
                # Fitted values and permuted residuals of the reduced model.
                mix = reduced[t] + (eye - reduced[t])[p]
                out.append(fs(mix @ a @ mix.T, t))
            else:
                out.append(fs(a[np.ix_(p, p)], t))
        return out

    null = _null(pairs.sparkSession, n, statistic, len(terms)) if n else np.zeros((0, len(terms)))
    rest = total - float(np.sum(full * a))
    rows = []
    for k, t in enumerate(terms):
        ss = float(np.sum((full - reduced[t]) * a))
        f = fs(a, t)
        rows.append((t, float(df[t]), ss, ss / df[t] if df[t] else None, None if np.isnan(f) else f, ss / total if total else None, _p(null[:, k], f)))
    rows.append(("Residual", float(df_res), rest, rest / df_res if df_res else None, None, rest / total if total else None, None))
    return pairs.sparkSession.createDataFrame(rows, "term string, df double, ss double, ms double, f double, r2 double, p double")


@dataclass
class _Constrained:
    names: list[str]
    y: np.ndarray
    x: np.ndarray
    columns: list[str]
    terms: dict[str, list[int]]
    condition: np.ndarray


def _constrained(pairs: DataFrame, meta: DataFrame, by: Sequence[str], condition: Sequence[str], interactions: Sequence[tuple[str, str]], correction: str, pcoa_fn: Callable[[list[str], np.ndarray], Ordination] | None = None, drop_first: bool = True) -> _Constrained:
    o = pcoa_matrix(*square(pairs), correction=correction) if pcoa_fn is None else pcoa_fn(*square(pairs))
    m = meta_frame(meta, o.names, [*by, *condition])
    x, columns, terms = design(m, by, interactions, drop_first)
    z, _, _ = design(m, condition, drop_first=drop_first)
    hz = hat(z)
    return _Constrained(o.names, o.scores - hz @ o.scores, x - hz @ x, columns, terms, hz)


def _inertia(h: np.ndarray, y: np.ndarray, compat: bool) -> float:
    return float(np.sum((h @ y) ** 2)) / (len(y) if compat else 1)


def dbrda(pairs: DataFrame, meta: DataFrame, by: Sequence[str] | str, condition: Sequence[str] = (), interactions: Sequence[tuple[str, str]] = (), axes: int = 2, n: int = 999, seed: int = 42, correction: str = "none", compat: bool = False, pcoa_fn: Callable[[list[str], np.ndarray], Ordination] | None = None, drop_first: bool = True) -> dict[str, DataFrame]:
    """sites (sample, axis, score), biplot (variable, axis, score), axes (axis,
    eigenvalue, percent), terms (term, percent of the constrained inertia) and
    test (constrained, total, r2, f, p). ``compat`` divides the constrained
    inertia by the number of samples and leaves the total as it is. ``pcoa_fn``
    makes the scores in place of ``pcoa_matrix``; without ``drop_first`` every
    level of a category has its column."""
    by = [by] if isinstance(by, str) else list(by)
    c = _constrained(pairs, meta, by, condition, interactions, correction, pcoa_fn, drop_first)
    spark = pairs.sparkSession
    h = hat(c.x)
    fit = h @ c.y
    u, s, vt = np.linalg.svd(fit, full_matrices=False)
    keep = s > 1e-10
    u, s, vt = u[:, keep], s[keep], vt[keep]
    turn = np.where(np.sign((_signed(u) * u).sum(axis=0)) < 0, -1.0, 1.0) if u.size else np.ones(0)
    sites = c.y @ (vt.T * turn)
    k = min(axes, len(s))
    size = len(c.names)
    q = int(round(np.trace(h)))
    rest_df = size - 1 - q - int(round(np.trace(c.condition)))
    total, own = float(np.sum(c.y**2)), _inertia(h, c.y, compat)

    def f(g: np.ndarray, y: np.ndarray) -> float:
        inside = _inertia(g, y, compat)
        outside = float(np.sum(y**2)) - inside
        return (inside / q) / (outside / rest_df) if q and rest_df > 0 and outside > 1e-12 else float("nan")

    observed = f(h, c.y)
    null = _null(spark, n, lambda it: [f(h, c.y[permuted_rows(it, size, seed)])], 1)[:, 0] if n else np.zeros(0)
    biplot = []
    for j, name in enumerate(c.columns):
        sd = c.x[:, j].std()
        for a in range(k):
            sa = (u[:, a] * turn[a]).std()
            r = float(np.mean((c.x[:, j] - c.x[:, j].mean()) * (u[:, a] * turn[a] - (u[:, a] * turn[a]).mean())) / (sd * sa)) if sd > 1e-12 and sa > 1e-12 else 0.0
            biplot.append((name, a + 1, r))
    marginal = {t: max(0.0, _inertia(h, c.y, compat) - _inertia(hat(np.delete(c.x, cols, axis=1)), c.y, compat)) for t, cols in c.terms.items()}
    whole = sum(marginal.values())
    return {
        "sites": spark.createDataFrame([(n_, a + 1, float(sites[i, a])) for i, n_ in enumerate(c.names) for a in range(k)], "sample string, axis int, score double"),
        "biplot": spark.createDataFrame(biplot, "variable string, axis int, score double"),
        "axes": spark.createDataFrame([(a + 1, float(s[a] ** 2), float(100 * s[a] ** 2 / np.sum(s**2))) for a in range(len(s))], "axis int, eigenvalue double, percent double"),
        "terms": spark.createDataFrame([(t, v, 100 * v / whole if whole else None) for t, v in marginal.items()], "term string, inertia double, percent double"),
        "test": spark.createDataFrame([(own, total, own / total if total else None, None if np.isnan(observed) else observed, _p(null, observed))], "constrained double, total double, r2 double, f double, p double"),
    }


def dbrda_marginal(pairs: DataFrame, meta: DataFrame, by: Sequence[str], condition: Sequence[str] = (), interactions: Sequence[tuple[str, str]] = (), n: int = 999, seed: int = 42, correction: str = "none", compat: bool = False, pcoa_fn: Callable[[list[str], np.ndarray], Ordination] | None = None, drop_first: bool = True) -> DataFrame:
    """term, df, f, p, f_alone, p_alone: each term given the others, with residuals
    of the model without it permuted, and each by itself."""
    c = _constrained(pairs, meta, list(by), condition, interactions, correction, pcoa_fn, drop_first)
    size, z = len(c.names), int(round(np.trace(c.condition)))
    full = hat(c.x)
    rank = int(round(np.trace(full)))
    without = {t: hat(np.delete(c.x, cols, axis=1)) for t, cols in c.terms.items()}
    alone = {t: hat(c.x[:, cols]) for t, cols in c.terms.items()}

    def f(big: np.ndarray, small: np.ndarray | None, y: np.ndarray) -> float:
        top = int(round(np.trace(big)))
        df = top - (int(round(np.trace(small))) if small is not None else 0)
        rest_df = size - 1 - top - z
        inside = _inertia(big, y, compat) - (_inertia(small, y, compat) if small is not None else 0.0)
        outside = float(np.sum(y**2)) - _inertia(big, y, compat)
        return (inside / df) / (outside / rest_df) if df and rest_df > 0 and outside > 1e-12 else float("nan")

    def statistic(it: int) -> list[float]:
        p, out = permuted_rows(it, size, seed), []
        for t in c.terms:
            y = without[t] @ c.y
            out += [f(full, without[t], y + (c.y - y)[p]), f(alone[t], None, c.y[p])]
        return out

    null = _null(pairs.sparkSession, n, statistic, 2 * len(c.terms)) if n else np.zeros((0, 2 * len(c.terms)))
    rows = []
    for k, t in enumerate(c.terms):
        a, b = f(full, without[t], c.y), f(alone[t], None, c.y)
        rows.append((t, float(rank - int(round(np.trace(without[t])))), None if np.isnan(a) else a, _p(null[:, 2 * k], a), None if np.isnan(b) else b, _p(null[:, 2 * k + 1], b)))
    return pairs.sparkSession.createDataFrame(rows, "term string, df double, f double, p double, f_alone double, p_alone double")


def dbrda_summary(pairs: DataFrame, meta: DataFrame, by: Sequence[str], n: int = 999, seed: int = 42, **how) -> DataFrame:
    """The terms of both with R2 and adjusted R2 of the whole, by p, then share."""
    whole = dbrda(pairs, meta, by, n=n, seed=seed, **how)
    marginal = dbrda_marginal(pairs, meta, list(by), n=n, seed=seed, **how)
    size = pairs.select(F.explode(F.array("s1", "s2")).alias("s")).distinct().count()
    rank = marginal.agg(F.sum("df")).first()[0]
    test = whole["test"].select(F.col("r2"), (1 - (1 - F.col("r2")) * (size - 1) / F.greatest(F.lit(1.0), F.lit(size - 1 - rank))).alias("r2_adjusted"), F.col("p").alias("p_model"))
    rows = whole["terms"].join(marginal, "term", "left").join(test)
    text = F.when(F.col("p") <= 0.05, F.when(F.col("p_alone") <= 0.05, F.lit("explains variation of its own")).otherwise(F.lit("significant only beside the others"))).otherwise(F.when(F.col("p_alone") <= 0.05, F.lit("shares its effect with the others")).otherwise(F.lit("no clear effect")))
    return rows.withColumn("interpretation", text).orderBy(F.asc_nulls_last("p"), F.desc("percent"))


def ellipse(scores: DataFrame, groups: DataFrame, deviations: float = 2.0) -> DataFrame:
    """grp, x, y, width, height, angle of covariance ellipses over axes 1 and 2."""
    wide = scores.groupBy("sample").pivot("axis", [1, 2]).agg(F.first("score")).toDF("sample", "a", "b").join(groups, "sample")
    m = wide.groupBy("grp").agg(F.avg("a").alias("x"), F.avg("b").alias("y"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 2")
    half, root = (F.col("va") + F.col("vb")) / 2, F.sqrt(F.pow((F.col("va") - F.col("vb")) / 2, F.lit(2.0)) + F.col("c") * F.col("c"))
    big, small = half + root, F.greatest(F.lit(0.0), half - root)
    return m.select("grp", "x", "y", (F.sqrt(big) * 2 * deviations).alias("width"), (F.sqrt(small) * 2 * deviations).alias("height"), F.degrees(F.atan2(big - F.col("va"), F.col("c"))).alias("angle"))


def biplot(scores: DataFrame, variables: DataFrame) -> DataFrame:
    """variable, axis, score: how variables (sample, variable, value) vary with
    the axes: the covariance of standardised values and scores."""
    rows = variables.join(scores.select("sample", "axis", "score"), "sample")
    return rows.groupBy("variable", "axis").agg(F.try_divide(F.covar_samp("value", "score"), F.stddev_samp("value")).alias("score"))
