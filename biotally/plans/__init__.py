"""Registered queries over the test tables."""

from pyspark.sql import DataFrame, SparkSession

from . import diversity_queries, fixtures, ordination_queries, statistics_queries, table_queries, view_queries  # noqa: F401
from .registry import ORACLES, QUERIES, rounded

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1, s2, value, region: q = 1 regional dissimilarity of the suppliers of a region."""
    from pyspark.sql import functions as F

    from ..operators.beta import naive_beta

    meta = fixtures.supplier_meta(spark, sf_dir).select("sample", "region")
    pairs = naive_beta(fixtures.tab_wide(spark, sf_dir), 1)
    one, two = meta.select(F.col("sample").alias("s1"), "region"), meta.select(F.col("sample").alias("s2"), F.col("region").alias("region2"))
    return rounded(pairs.join(one, "s1").join(two, "s2").where("region = region2").select("s1", "s2", "region", "value"))
