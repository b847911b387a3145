"""Raup-Crick by rows: keys within a bound, those of samples with too few of them
from all, and further reads in chunks give the tables of the SQL's plain order."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from biotally.operators import nulls


def uniform(name):
    return (int(hashlib.md5(name.encode()).hexdigest()[:12], 16) + 0.5) / 281474976710656.0


def plain(cells, n, seed):
    ab, fr = Counter(), Counter()
    for f, _, v in cells:
        ab[f] += int(v)
        fr[f] += 1
    out = {}
    for it in range(1, n + 1):
        for s in {c[1] for c in cells}:
            own = [int(v) for _, t, v in cells if t == s]
            keys = sorted((-math.log(uniform(f"{seed}:{it}:{s}:{f}")) / fr[f], f) for f in fr)
            chosen = sorted(f for _, f in keys[: len(own)])
            table, total = Counter(chosen), sum(ab[f] for f in chosen)
            for i in range(1, sum(own) - len(own) + 1):
                at = math.floor(uniform(f"{seed}:{it}:{s}:read:{i}") * total)
                for f in chosen:
                    if at < ab[f]:
                        table[f] += 1
                        break
                    at -= ab[f]
            out |= {(it, f, s): float(v) for f, v in table.items()}
    return out


@pytest.mark.parametrize("margin", [8.0, 0.0, -1.0])
def test_tables_of_all_keys(spark, monkeypatch, margin):
    monkeypatch.setattr(nulls, "MARGIN", margin)
    monkeypatch.setattr(nulls, "DRAWS", 16)
    cells = [(f"f{(7 * j + k * k) % 400}", f"s{j}", float(1 + (j * k) % 9)) for j in range(8) for k in range(12 + j)]
    cells = list({c[:2]: c for c in cells}.values())
    tab = spark.createDataFrame(cells, "feature string, sample string, value double")
    got = {tuple(r)[:3]: r["value"] for r in nulls.random_tables(tab, 2, 3).select("it", "feature", "sample", "value").collect()}
    assert got == plain(cells, 2, 3)


def test_keys_beyond_the_bound_are_not_ranked(spark):
    pool = spark.range(5000).select(F.lit("g").alias("grp"), F.concat(F.lit("f"), "id").alias("feature"), F.lit(1).cast("long").alias("abundance"), F.lit(1).cast("long").alias("frequency"))
    each = spark.createDataFrame([("g", "s", 5, 9, 0.02, 1)], "grp string, sample string, richness long, reads long, bound double, it long")
    found = nulls._chosen(each, pool, F.col("frequency").cast("double"), 1).first()["found"]
    assert 5 <= found < 300
