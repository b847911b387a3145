"""The data behind figures that no other operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_contributions(contributions: DataFrame, n: int = 20) -> DataFrame:
    """grp, feature, pct of the n features that add most to dissimilarity, by
    their mean over groups; ties by name."""
    mean = contributions.groupBy("feature").agg(F.round(F.avg("pct"), 8).alias("mean")).orderBy(F.desc("mean"), "feature").limit(n)
    return contributions.join(F.broadcast(mean.select("feature")), "feature", "left_semi").select("grp", "feature", "pct")


def tip_abundance(tab: DataFrame, groups: DataFrame) -> DataFrame:
    """feature, grp, pct: mean relative abundance over all samples of a group."""
    p = tab.where("value > 0").withColumn("p", F.col("value") / F.sum("value").over(Window.partitionBy("sample")) * 100)
    size = tab.select("sample").distinct().join(groups, "sample").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return p.join(groups, "sample").groupBy("feature", "grp").agg(F.sum("p").alias("s")).join(size, "grp").select("feature", "grp", (F.col("s") / F.col("n")).alias("pct"))


def clipped(table: DataFrame, value: str = "pct") -> DataFrame:
    """Shares kept within 0 and 100; what is no number is 0."""
    x = F.coalesce(F.nanvl(F.expr(f"try_cast(`{value}` as double)"), F.lit(0.0)), F.lit(0.0))
    return table.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def design_matrix(meta: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """sample, variable, value: centred numbers, and centred indicators of every
    level but the first, by name."""
    parts = []
    if numeric:
        parts.append(meta.select("sample", *[F.col(c).cast("double").alias(c) for c in numeric]).unpivot("sample", numeric, "variable", "value"))
    for c in categorical:
        levels = meta.select(F.col(c).cast("string").alias("level")).where("level is not null").distinct()
        rest = levels.withColumn("n", F.row_number().over(Window.orderBy("level"))).where("n > 1").drop("n")
        rows = meta.select("sample", F.col(c).cast("string").alias("own")).join(F.broadcast(rest))  # levels beside each sample
        parts.append(rows.select("sample", F.concat(F.lit(f"{c}="), "level").alias("variable"), F.when(F.col("own") == F.col("level"), 1.0).otherwise(0.0).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("variable")))
