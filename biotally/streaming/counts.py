"""Counts that arrive over time: a running table and windowed diversity.

The table is an aggregation that Spark keeps as state, so any batch operator
reads what a sink of it holds; windows close once the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hill import is_one


def running_table(events: DataFrame, feature: str = "feature", sample: str = "sample", value: str | None = None) -> DataFrame:
    """feature, sample, value so far; events count 1 each without ``value``."""
    amount = F.sum(value) if value else F.count(F.lit(1))
    return events.groupBy(F.col(feature).alias("feature"), F.col(sample).cast("string").alias("sample")).agg(amount.cast("double").alias("value"))


def windowed_counts(events: DataFrame, time: str, length: str, late: str, feature: str = "feature", sample: str = "sample") -> DataFrame:
    """start, feature, sample, value per window of event time; events later than
    ``late`` are left out."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, length), F.col(feature).alias("feature"), F.col(sample).cast("string").alias("sample"))
    return rows.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.col("window.start").alias("start"), "feature", "sample", "value")


def windowed_alpha(counts: DataFrame, q: float = 1) -> DataFrame:
    """start, sample, d of closed windows (start, feature, sample, value)."""
    v = F.col("value")
    if is_one(q):
        d = F.exp(F.ln(F.sum(v)) - F.sum(v * F.ln(v)) / F.sum(v))
    else:
        d = F.pow(F.sum(F.pow(v, F.lit(float(q)))) / F.pow(F.sum(v), F.lit(float(q))), F.lit(1.0 / (1.0 - q)))
    return counts.groupBy("start", "sample").agg(d.alias("d"))
