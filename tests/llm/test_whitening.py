"""Whitening against numpy and whole numbers of Python."""

import collections
import math

import numpy as np
import pytest

from biotally.llm import queries, whitening

ROWS = "vec_id long, embedding array<float>, label int, x int, n string"
SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0, 1, "n") for k, v in rows], ROWS)


def brute(rows, components=4):
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(k, tuple(x) + (0,) * (d - len(x))) for k, x in kept]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for x in fit], dtype=object)
    c = (centred / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, n, sums, values[:components], vectors[:, :components], values.sum()


def check(got, rows):
    kept, n, sums, values, vectors, trace = brute(rows)
    want = collections.Counter()
    for k, x in kept:
        want[k, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))] += 1
    assert collections.Counter((r["vec_id"], r["n"], r["deviation"]) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r["whitened"])
    signs = None
    for k, x in kept:
        y = (np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)]) @ vectors) / np.sqrt(values)
        close = [g for g in by[k] if np.allclose(np.abs(g), np.abs(y), rtol=1e-6, atol=1e-7)]
        assert close
        if signs is None and np.abs(y).min() > 1e-3:
            signs = np.sign(close[0]) * np.sign(y)
        if signs is not None:
            assert any(np.allclose(g, y * signs, rtol=1e-6, atol=1e-7) for g in close)
    for r in got:
        assert np.allclose(r["explained"], values / trace, rtol=1e-9)
        assert r["identity_error"] < 1e-8


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(90, 7)) @ rng.normal(size=(7, 7))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    rows += [(1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (200, None), (201, [float("nan")] * 7), (202, [1.0, None, 2.0, 0, 0, 0, 0]), (203, [float("inf")] + [0.0] * 6), (204, [-0.0] * 7), (205, [1.0, -2.5]), (206, []), (2**53 + 1, rows[5][1])]
    rows += [(300 + i, rows[0][1]) for i in range(60)]
    rows = [(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in rows]
    check([r.asDict() for r in whitening.whiten(frame(spark, rows)).collect()], rows)


def test_registered_query(spark):
    got = queries.op12_whitening(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    assert all(sorted(c) == [1, 2, 3, 4] for c in by.values())
    check([{"vec_id": k, "n": c[1]["n"], "deviation": c[1]["deviation"], "whitened": [c[i]["whitened"] for i in (1, 2, 3, 4)], "explained": [c[i]["explained"] for i in (1, 2, 3, 4)], "identity_error": c[1]["identity_error"]} for k, c in by.items()], rows)


def test_defined_cases(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, []), (3, [None])])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, [None, None], [None, None], None)] * 2
    flat = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted(round(abs(r["whitened"][0]), 9) for r in flat) == [1, 1]
    assert all(r["whitened"][1] is None for r in flat)


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(np.float32(k * 1e9)), float(np.float32(-3e8 * k * k))]) for k in range(6)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    kept, n, sums, *_ = brute(rows)
    for k, x in kept:
        exact = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert got[k] == (exact if exact < 2**63 else None)
    assert None in got.values()


@pytest.mark.parametrize("far", [3e38, -3e38])
def test_entries_beyond_64_bits_do_not_stop_it(spark, far):
    got = whitening.whiten(frame(spark, [(1, [far, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 3.0])])).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3]
