"""Near pairs of repeated sequences: features meet as lists, not as rows."""

import pytest

from biotally.operators import sequences


def plain(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (a != b)))
    return row[-1]


@pytest.mark.parametrize("members", [1, 4, 1024])
def test_every_pair_once(spark, monkeypatch, members):
    monkeypatch.setattr(sequences, "MEMBERS", members)
    texts = ["abcdef", "abcdeg", "abXYef", "", "a", "zzzzzzz"]
    rows = [(f"f{k}", texts[k % 6]) for k in range(40)]
    got = sorted(tuple(r) for r in sequences.similar(spark.createDataFrame(rows, "feature string, seq string"), 1).select("f1", "f2", "distance").collect())
    want = sorted((*sorted((a, b)), plain(x, y)) for k, (a, x) in enumerate(rows) for b, y in rows[k + 1 :] if plain(x, y) <= 1)
    assert got == want and len(got) > 150


def test_tasks_do_not_follow_bytes(spark):
    """Few short rows may stand for many pairs: they are dealt by number."""
    rows = spark.createDataFrame([(f"f{k}", "abcdef"[: 3 + k % 3]) for k in range(9)], "feature string, seq string")
    plan = sequences.similar(rows, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2
