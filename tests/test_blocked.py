"""Blocked ordination and permutation tests against dense algebra."""

import itertools

import numpy as np
import pandas as pd
import pytest

from biotally.operators import blocked, ordination

PAIRS = "s1 string, s2 string, value double"


def drawn(seed, n, noise=0.3):
    """Distances of points with a group structure, not quite Euclidean."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + group[:, None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + noise * np.abs(rng.normal(size=(n, n)))
    d = (d + d.T) / 2
    names = [f"s{k:03d}" for k in range(n)]
    pairs = [(names[i], names[j], float(d[i, j])) for i, j in itertools.combinations(range(n), 2)]
    meta = pd.DataFrame({"sample": names, "grp": [f"g{g}" for g in group], "x": rng.normal(size=n), "block": [f"b{k % 4}" for k in range(n)]})
    return names, d, pairs, meta


@pytest.mark.parametrize(("n", "size"), [(23, 7), (40, 64), (31, 1)])
def test_blocks(spark, n, size):
    _, d, pairs, _ = drawn(1, n)
    m = blocked.blocked(spark.createDataFrame(pairs, PAIRS), size)
    a = -0.5 * d * d
    np.fill_diagonal(a, 0)
    for r in m.cells.collect():
        i, j = r["i"] * size, r["j"] * size
        assert np.allclose(np.frombuffer(r["data"]).reshape(m.rows(r["i"]), -1), a[i : i + size, j : j + size])
    assert m.grand == pytest.approx(a.mean())
    x = np.random.default_rng(2).normal(size=(n, 3))
    strips = spark.createDataFrame([(b, x[b * size : (b + 1) * size].tobytes()) for b in range(-(-n // size))], "b int, data binary")
    got = np.concatenate([np.frombuffer(r["data"]).reshape(-1, 3) for r in sorted(blocked.times(m, strips).collect(), key=lambda r: r["b"])])
    assert np.allclose(got, a @ x)
    assert np.allclose(blocked._gram(strips, m), x.T @ x)


@pytest.mark.parametrize(("n", "size", "axes"), [(30, 8, 30), (60, 16, 5)])
def test_pcoa(spark, n, size, axes):
    _, _, pairs, _ = drawn(3, n, noise=0.05)
    df = spark.createDataFrame(pairs, PAIRS)
    got = blocked.pcoa(df, axes, passes=8, size=size).toPandas()
    want = ordination.pcoa(df).toPandas()
    values = want.groupby("axis")["eigenvalue"].first().to_numpy()[:axes]
    own = got.groupby("axis")["eigenvalue"].first().to_numpy()
    k = min(len(values), len(own), axes if axes < n else len(values))
    assert np.allclose(own[:4], values[:4], rtol=1e-6)
    assert np.allclose(own[:k], values[:k], rtol=1e-2)
    for axis in range(1, 4):
        a = got[got["axis"] == axis].set_index("sample")["score"].sort_index().to_numpy()
        b = want[want["axis"] == axis].set_index("sample")["score"].sort_index().to_numpy()
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-4


def plain(d, x, terms, moves, scheme):
    """F of each term for each permutation, by whole hat matrices."""
    n = len(d)
    a = ordination._centered(d)
    full = ordination.hat(x)
    rank = int(round(np.trace(full)))
    out = []
    for p in moves:
        row = []
        for cols in terms.values():
            red = ordination.hat(np.delete(x, cols, axis=1))
            df = rank - int(round(np.trace(red)))
            if scheme == "labels":
                g = a[np.ix_(p, p)]
            else:
                mix = red + (np.eye(n) - red)[p]
                g = mix @ a @ mix.T
            ss, rest = np.sum((full - red) * g), np.trace(g) - np.sum(full * g)
            row.append((ss / df) / (rest / (n - 1 - rank)))
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize(("by", "interaction", "strata", "scheme"), [("grp", False, None, "labels"), (["grp", "x"], True, None, "labels"), (["grp", "x"], False, "block", "labels"), (["grp", "x"], False, None, "freedman-lane"), (["grp", "x"], True, "block", "freedman-lane")])
def test_permanova(spark, by, interaction, strata, scheme):
    names, d, pairs, meta = drawn(5, 27)
    df, m = spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(meta)
    n = 19
    got = {r["term"]: r for r in blocked.permanova(df, m, by, n, 3, interaction, strata, scheme, size=8).collect()}
    want = {r["term"]: r for r in ordination.permanova(df, m, by, 0, include_interaction=interaction).collect()}
    assert got.keys() == want.keys()
    for t, w in want.items():
        for c in ("df", "ss", "ms", "f", "r2"):
            assert (got[t][c] is None) == (w[c] is None) and (w[c] is None or got[t][c] == pytest.approx(w[c]))
    # The same permutations through whole matrices give the same p.
    ids = m.selectExpr("sample", f"{strata or repr('')} as stratum")
    at = {s: k for k, s in enumerate(names)}
    moves = np.zeros((n + 1, len(names)), dtype=int)
    moves[0] = np.arange(len(names))
    for r in blocked.relabelled(ids, n, 3).collect():
        # A basis' row of ``to`` comes to ``sample``: the matrix goes the other way.
        if scheme == "labels":
            moves[r["it"], at[r["to"]]] = at[r["sample"]]
        else:
            moves[r["it"], at[r["to"]]] = at[r["sample"]]
    by = [by] if isinstance(by, str) else by
    x, _, terms = ordination.design(meta.set_index("sample").loc[names], by, [tuple(by)] if interaction else ())
    f = plain(d, x, terms, moves, scheme)
    for k, t in enumerate(terms):
        p = (np.sum(np.round(f[1:, k], 10) >= round(f[0, k], 10)) + 1) / (n + 1)
        assert got[t]["p"] == pytest.approx(p), (t, f[:, k])


def test_small_and_constant(spark):
    one = spark.createDataFrame([("a", "b", 1.0)], PAIRS)
    assert [round(abs(r["score"]), 9) for r in blocked.pcoa(one, 3).collect()] == [0.5, 0.5]
    assert blocked.pcoa(one.limit(0)).collect() == []
    meta = spark.createDataFrame([("a", "x"), ("b", "x")], "sample string, grp string")
    got = {r["term"]: r for r in blocked.permanova(one, meta, "grp", 3).collect()}
    assert got["grp"]["df"] == 0 and got["grp"]["p"] is None and got["Residual"]["ss"] == pytest.approx(0.5)
