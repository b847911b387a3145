"""Every query with an oracle, against the oracle's engine at the smallest scale."""

import math

import duckdb
import pytest

from biotally.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x + 0.0, 5)
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in data), key=repr)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(ORACLES[name])
    cols = [c[0] for c in rel.description]
    want = rows(cols, rel.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want)
    assert all(close(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
