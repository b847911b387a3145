"""Ranks of values that are not the same when they are computed again."""

from pyspark.sql import functions as F

from biotally.operators.relational import average_ranks


def test_values_that_change_keep_their_rows(spark):
    rows = spark.range(300).repartition(4).select("id", F.pandas_udf(lambda x: x * 0 + __import__("numpy").random.default_rng().random(len(x)), "double")("id").alias("v"))
    got = average_ranks(rows, "v", "r", "id").orderBy("v").collect()
    assert [r["r"] for r in got] == [float(k) for k in range(1, 301)]
