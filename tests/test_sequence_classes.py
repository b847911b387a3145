"""Edits between all pairs, counted once for features of equal sequences."""

import pytest
from pyspark.sql import functions as F

from biotally.operators import combine


def plain(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (a != b)))
    return row[-1]


@pytest.mark.parametrize("band", [None, 50])
def test_all_pairs_once(spark, monkeypatch, band):
    monkeypatch.setattr(combine, "MEMBERS", 3)
    texts = ["abc", "abd", "", "xyz"]
    rows = [(f"f{k}", texts[k % 4]) for k in range(30)] + [("f5", "abc")]
    got = sorted(tuple(r) for r in combine.sequence_distance(spark.createDataFrame(rows, "feature string, seq string"), band).select("f1", "f2", "distance").collect())
    assert got == sorted((a, b, plain(x, y)) for a, x in rows for b, y in rows if a < b)


def test_equal_sequences_are_compared_once(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("feature"), F.lit("same").alias("seq"))
    calls = spark.sparkContext.accumulator(0)

    def counted(x, y, band):
        @F.pandas_udf("int")
        def edits(a, b):
            calls.add(len(a))
            return a.str.len() * 0

        return edits(x, y)

    real, combine.banded_column = combine.banded_column, counted
    try:
        assert combine.sequence_distance(rows, 4).count() == 400 * 399 // 2
        assert combine.sequence_distance(rows, 4).agg(F.sum("distance")).first()[0] == 0
    finally:
        combine.banded_column = real
    assert calls.value < 100
