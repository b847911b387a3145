"""Taxonomy tables: cleaning, prefixes, grouping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import dealt

# Ranks with their prefixes, and what stands for an unknown taxon.
PREFIX = {"superkingdom": "sk__", "clade": "cl__", "kingdom": "k__", "domain": "d__", "realm": "r__", "phylum": "p__", "class": "c__", "order": "o__", "family": "f__", "subfamily": "sf__", "genus": "g__", "species": "s__"}
UNKNOWN = ("", "unassigned", "unknown", "none", "na", "n/a", "nan")


def ranks_of(tax: DataFrame) -> list[str]:
    return [c for c in tax.columns if c != "feature"]


def prefix_of(rank: str) -> str:
    return PREFIX.get(rank.lower(), f"{rank[0].lower()}__")


def clean_rank(col: Column, prefix: str) -> Column:
    """Unknowns null; prefixes lower-cased or added; numeric tails removed."""
    s = F.trim(col)
    lowered = F.when(s.startswith(prefix), s).when(s.rlike("^[A-Za-z]+__"), F.concat(F.lower(F.regexp_extract(s, "^([A-Za-z]+)__", 1)), F.lit("__"), F.regexp_replace(s, "^[A-Za-z]+__", ""))).otherwise(s)
    known = F.lit(False)
    for p in PREFIX.values():
        known = known | lowered.startswith(p)
    full = F.when(known, lowered).otherwise(F.concat(F.lit(prefix), lowered))
    return F.when(s.isNull() | F.lower(s).isin(*UNKNOWN), F.lit(None)).otherwise(F.regexp_replace(F.trim(full), r"_\d+$", ""))


def clean_taxonomy(tax: DataFrame) -> DataFrame:
    return tax.select(*[clean_rank(F.col(c), PREFIX[c.lower()]).alias(c) if c.lower() in PREFIX else F.col(c) for c in tax.columns])


def tax_prefix(tax: DataFrame, add: bool = True, custom: dict[str, str] | None = None) -> DataFrame:
    """Prefixes added where there is none (and more than a letter), or removed."""
    out = []
    for c in tax.columns:
        if c == "feature":
            out.append(F.col(c))
        elif add:
            p = (custom or {}).get(c, prefix_of(c))
            out.append(F.when(F.col(c).isNotNull() & ~F.col(c).contains("__") & (F.length(c) > 1), F.concat(F.lit(p), F.col(c))).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col(c).contains("__"), F.split(c, "__")[1]).otherwise(F.col(c)).alias(c))
    return tax.select(*out)


def filled(tax: DataFrame, upto: str) -> DataFrame:
    """Ranks down to ``upto``, gaps filled from the rank above."""
    names = ranks_of(tax)
    names = names[: [n.lower() for n in names].index(upto.lower()) + 1]
    top = names[0]
    df = tax.select("feature", *names).withColumn(top, F.when(F.col(top).isNull() | (F.trim(top) == ""), F.lit(f"{prefix_of(top)}Unclassified")).otherwise(F.col(top)))
    for parent, child in zip(names, names[1:], strict=False):
        from_parent = F.when(F.lower(parent).contains("unclassified"), F.col(parent)).otherwise(F.concat(F.col(parent), F.lit(" unclassified")))
        df = df.withColumn(child, F.when(F.col(child).isNull() | (F.length(child) < 4), from_parent).otherwise(F.col(child)))
    return df


def group_by_taxa(tab: DataFrame, tax: DataFrame, levels: Sequence[str] | str, tasks: int | None = None) -> DataFrame:
    """name, sample, value: the table by taxon, named by the levels. Features
    are grouped on their whole lineage, then on the name."""
    levels = [levels] if isinstance(levels, str) else list(levels)
    names = ranks_of(tax)
    wanted = [next(n for n in names if n.lower() == x.lower()) for x in levels]
    df = filled(tax, wanted[-1])
    label = F.col(wanted[0])
    for parent, child in zip(wanted, wanted[1:], strict=False):
        label = F.when(F.col(parent) == F.col(child), label).otherwise(F.concat(label, F.lit("; "), F.col(child)))
    rows = dealt(tab.where("value > 0"), tasks, "feature").join(df.select("feature", label.alias("name")), "feature")
    return dealt(rows, tasks, "name", "sample").groupBy("name", "sample").agg(F.sum("value").alias("value"))


def top_taxa(tab: DataFrame, tax: DataFrame, levels: Sequence[str] | str, groups: DataFrame | None = None, n: int = 20, method: str = "max") -> DataFrame:
    """name, sample, pct of the n largest taxa, absent ones 0: what a heatmap
    shows. Groups (sample, grp) are merged by sum first."""
    from pyspark.sql import Window

    if groups is not None:
        tab = tab.join(groups, "sample").groupBy("feature", F.col("grp").alias("sample")).agg(F.sum("value").alias("value"))
    pct = tab.where("value > 0").withColumn("value", F.col("value") / F.sum("value").over(Window.partitionBy("sample")) * 100)
    named = group_by_taxa(pct, tax, levels)
    score = F.max("value") if method == "max" else F.sum("value")
    top = named.groupBy("name").agg(F.round(score, 8).alias("score")).orderBy(F.desc("score"), "name").limit(n).select("name")
    spine = named.select("sample").distinct().join(F.broadcast(top))  # n names beside each sample
    return spine.join(named, ["name", "sample"], "left").select("name", "sample", F.coalesce("value", F.lit(0.0)).alias("pct"))


def with_other(table: DataFrame) -> DataFrame:
    """The shares with what is missing to 100, where any sample lacks it."""
    sums = table.groupBy("sample").agg(F.sum("pct").alias("s"))
    need = sums.agg((F.min("s") < 99.9999).alias("need"))
    other = sums.join(F.broadcast(need)).where("need").select(F.lit("Other").alias("name"), "sample", (F.lit(100.0) - F.col("s")).alias("pct"))
    rows = table.unionByName(other)
    return rows.withColumn("pct", F.when((F.col("pct") < 0) & (F.col("pct") > -0.1), F.lit(0.0)).otherwise(F.col("pct")))
