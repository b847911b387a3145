"""The test tables as community tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import dealt, tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, d: str) -> int:
    """As many as ``tab_wide`` asks for."""
    return tasks_for(read(spark, d, "lineitem"))


def rows_wide(spark: SparkSession, d: str) -> DataFrame:
    """The rows that ``tab_wide`` adds up."""
    return read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").cast("double").alias("value"))


def tab_wide(spark: SparkSession, d: str, by: str = "feature") -> DataFrame:
    """Parts in suppliers, by quantity; a task's part of it does not grow."""
    return dealt(rows_wide(spark, d), tasks(spark, d), by).groupBy("feature", "sample").agg(F.sum("value").alias("value"))


def tab_small(spark: SparkSession, d: str) -> DataFrame:
    """Brands in nations, by quantity."""
    li, p, s = (read(spark, d, n) for n in ("lineitem", "part", "supplier"))
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return rows.groupBy(F.col("p_brand").alias("feature"), F.col("s_nationkey").cast("string").alias("sample")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def tab_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("feature"), F.col("user_id").cast("string").alias("sample")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def supplier_meta(spark: SparkSession, d: str) -> DataFrame:
    """sample, region, nation, acctbal."""
    s, n, r = (read(spark, d, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.select(F.col("s_suppkey").cast("string").alias("sample"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("s_acctbal").cast("double").alias("acctbal"))


def nation_meta(spark: SparkSession, d: str) -> DataFrame:
    """sample, region, n_suppliers, mean_acctbal."""
    s, n, r = (read(spark, d, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.groupBy(F.col("s_nationkey").cast("string").alias("sample"), F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("n_suppliers"), F.avg(F.col("s_acctbal").cast("double")).alias("mean_acctbal"))


def regions(meta: DataFrame) -> DataFrame:
    return meta.select("sample", F.col("region").alias("grp"))


def distmat(spark: SparkSession, d: str) -> DataFrame:
    """Brands by how far apart their mean sizes are."""
    p = read(spark, d, "part").groupBy("p_brand").agg(F.avg(F.col("p_size").cast("double")).alias("m"))
    a, b = p.select(F.col("p_brand").alias("f1"), F.col("m").alias("m1")), p.select(F.col("p_brand").alias("f2"), F.col("m").alias("m2"))
    return a.join(b, F.col("f1") != F.col("f2")).select("f1", "f2", F.abs(F.col("m1") - F.col("m2")).alias("d"))


def tree_small(spark: SparkSession, d: str) -> DataFrame:
    """Root, five clades, brands."""
    p = read(spark, d, "part").groupBy("p_brand").agg(F.min(F.struct("p_partkey", "p_size"))["p_size"].alias("size"))
    clade = F.concat(F.lit("clade"), (F.col("size") % 5).cast("string"))
    tips = p.select(F.col("p_brand").alias("node"), clade.alias("parent"), F.lit(0.3).alias("branchL"))
    clades = tips.select(F.col("parent").alias("node"), F.lit("root").alias("parent"), F.lit(0.7).alias("branchL")).distinct()
    root = spark.createDataFrame([("root", None, 0.0)], "node string, parent string, branchL double")
    return root.unionByName(clades).unionByName(tips)


def leaves_small(spark: SparkSession, d: str) -> DataFrame:
    """The closure of ``tree_small``, straight from its three levels."""
    t = tree_small(spark, d)
    tips = t.where("parent like 'clade%'")
    return tips.select("node", F.col("node").alias("leaf")).unionByName(tips.select(F.col("parent").alias("node"), F.col("node").alias("leaf"))).unionByName(tips.select(F.lit("root").alias("node"), F.col("node").alias("leaf")))


def tree_large(spark: SparkSession, d: str) -> DataFrame:
    """Root, types, brands within types, parts."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("part"), F.col("p_type").alias("type"), F.concat_ws("/", "p_type", "p_brand").alias("brand"))
    tips = p.select(F.col("part").alias("node"), F.col("brand").alias("parent"), F.lit(0.2).alias("branchL"))
    brands = p.select(F.col("brand").alias("node"), F.col("type").alias("parent"), F.lit(0.3).alias("branchL")).distinct()
    types = p.select(F.col("type").alias("node"), F.lit("root").alias("parent"), F.lit(0.5).alias("branchL")).distinct()
    root = spark.createDataFrame([("root", None, 0.0)], "node string, parent string, branchL double")
    return root.unionByName(types).unionByName(brands).unionByName(tips)


def leaves_large(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("leaf"), F.col("p_type").alias("type"), F.concat_ws("/", "p_type", "p_brand").alias("brand"))
    return p.select("leaf", F.explode(F.array("leaf", "brand", "type", F.lit("root"))).alias("node")).select("node", "leaf")


def tree_uneven(spark: SparkSession, d: str) -> DataFrame:
    """``tree_large`` with tips as long as their parts are large."""
    p = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), (F.lit(0.2) + F.col("p_size") / 10).alias("own"))
    return tree_large(spark, d).join(p, "node", "left").select("node", "parent", F.coalesce("own", "branchL").alias("branchL"))


def tree_types(spark: SparkSession, d: str) -> DataFrame:
    """Root, types, and brands within types as leaves, by their parts' mean size."""
    p = read(spark, d, "part").select(F.col("p_type").alias("type"), F.concat_ws("/", "p_type", "p_brand").alias("brand"), "p_size")
    tips = p.groupBy(F.col("brand").alias("node"), F.col("type").alias("parent")).agg((F.avg(F.col("p_size").cast("double")) / 50).alias("branchL"))
    types = p.select(F.col("type").alias("node"), F.lit("root").alias("parent"), F.lit(0.5).alias("branchL")).distinct()
    return spark.createDataFrame([("root", None, 0.0)], "node string, parent string, branchL double").unionByName(types).unionByName(tips)


def tax(spark: SparkSession, d: str) -> DataFrame:
    """feature, Domain, Phylum, Genus; with unknowns, blanks and nulls among them."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    phylum = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit(" Unknown ")).otherwise(F.concat(F.lit("P__"), F.col("p_brand")))
    genus = F.when(k % 11 == 3, F.lit("")).when(k % 13 == 0, F.lit(None)).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("x_"), (k % 3).cast("string")))
    return p.select(k.cast("string").alias("feature"), F.concat(F.lit("d__"), F.col("p_type")).alias("Domain"), phylum.alias("Phylum"), genus.alias("Genus"))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("feature"), F.concat(F.lit("d__"), F.col("p_type"), F.lit(";p__"), F.col("p_brand"), F.lit(";g__"), F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_size").cast("string"))).alias("lineage"))


def seq(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_name").alias("seq"))


def seq_long(spark: SparkSession, d: str) -> DataFrame:
    """Names, types and brands as sequences, few of them equal."""
    p = read(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("feature"), F.concat("p_name", F.lit("/"), "p_type", F.lit("/"), "p_brand").alias("seq"))


#: The same tables for the oracle, by name; a query names those it needs.
SQL = {
    "tab_wide": "SELECT CAST(l_partkey AS VARCHAR) feature, CAST(l_suppkey AS VARCHAR) sample, SUM(CAST(l_quantity AS DOUBLE)) value FROM lineitem GROUP BY ALL",
    "tab_small": "SELECT p_brand feature, CAST(s_nationkey AS VARCHAR) sample, SUM(CAST(l_quantity AS DOUBLE)) value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "tab_events": "SELECT event_type feature, CAST(user_id AS VARCHAR) sample, CAST(COUNT(*) AS DOUBLE) value FROM events GROUP BY ALL",
    "supplier_meta": "SELECT CAST(s_suppkey AS VARCHAR) sample, r_name region, n_name nation, CAST(s_acctbal AS DOUBLE) acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "nation_meta": "SELECT CAST(s_nationkey AS VARCHAR) sample, r_name region, COUNT(*) n_suppliers, AVG(CAST(s_acctbal AS DOUBLE)) mean_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "distmat": "SELECT a.p_brand f1, b.p_brand f2, ABS(a.m - b.m) d FROM (SELECT p_brand, AVG(CAST(p_size AS DOUBLE)) m FROM part GROUP BY 1) a JOIN (SELECT p_brand, AVG(CAST(p_size AS DOUBLE)) m FROM part GROUP BY 1) b ON a.p_brand <> b.p_brand",
    "tips_small": "SELECT p_brand node, 'clade' || CAST(arg_min(p_size, p_partkey) % 5 AS VARCHAR) parent FROM part GROUP BY 1",
    "tree_small": "SELECT 'root' node, NULL parent, CAST(0 AS DOUBLE) branchL UNION ALL SELECT DISTINCT parent, 'root', CAST(0.7 AS DOUBLE) FROM tips_small UNION ALL SELECT node, parent, CAST(0.3 AS DOUBLE) FROM tips_small",
    "leaves_small": "SELECT node, node leaf FROM tips_small UNION ALL SELECT parent, node FROM tips_small UNION ALL SELECT 'root', node FROM tips_small",
    "tree_large": "SELECT 'root' node, NULL parent, CAST(0 AS DOUBLE) branchL UNION ALL SELECT DISTINCT p_type, 'root', CAST(0.5 AS DOUBLE) FROM part UNION ALL SELECT DISTINCT p_type || '/' || p_brand, p_type, CAST(0.3 AS DOUBLE) FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_type || '/' || p_brand, CAST(0.2 AS DOUBLE) FROM part",
    "leaves_large": "SELECT UNNEST([CAST(p_partkey AS VARCHAR), p_type || '/' || p_brand, p_type, 'root']) node, CAST(p_partkey AS VARCHAR) leaf FROM part",
    "tax": "SELECT CAST(p_partkey AS VARCHAR) feature, 'd__' || p_type \"Domain\", CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ' Unknown ' ELSE 'P__' || p_brand END \"Phylum\", CASE WHEN p_partkey % 11 = 3 THEN '' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size || 'x_' || (p_partkey % 3) END \"Genus\" FROM part",
    "lineage": "SELECT CAST(p_partkey AS VARCHAR) feature, 'd__' || p_type || ';p__' || p_brand || ';g__' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END lineage FROM part",
    "seq_long": "SELECT CAST(p_partkey AS VARCHAR) feature, p_name || '/' || p_type || '/' || p_brand seq FROM part",
    "seq": "SELECT CAST(p_partkey AS VARCHAR) feature, p_name seq FROM part",
}
