"""Queries on tables, taxonomy, parsers and views, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import taxonomy
from ..sources import newick, text
from . import fixtures as fx
from .diversity_queries import P, from_sum, term
from .registry import r, register, sql


def u(*parts: str) -> str:
    return f"((('0x' || SUBSTR(MD5(CONCAT_WS(':', {', '.join(parts)})), 1, 12))::BIGINT + 0.5) / 281474976710656)"


def md5(*parts: str) -> str:
    return f"MD5(CONCAT_WS(':', {', '.join(parts)}))"


# -- selecting

register("subset_samples_region", lambda s, d: rel.subset_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), "region", ["ASIA", "EUROPE"])[0], sql("tab_wide, supplier_meta", "SELECT t.* FROM tab_wide t JOIN supplier_meta USING (sample) WHERE region IN ('ASIA', 'EUROPE')"))
register("subset_samples_exclude", lambda s, d: rel.subset_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), "region", ["ASIA"], exclude=True)[0], sql("tab_wide, supplier_meta", "SELECT t.* FROM tab_wide t JOIN supplier_meta USING (sample) WHERE region <> 'ASIA'"))
register("subset_samples_index", lambda s, d: rel.subset_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), "index", ["1", "2", "7"])[1], sql("supplier_meta", f"SELECT sample, region, nation, {r('acctbal', 'acctbal')} FROM supplier_meta WHERE sample IN ('1', '2', '7')"))
register("subset_features", lambda s, d: rel.subset_features(fx.tab_wide(s, d), fx.tax(s, d).where("Phylum is null")), sql("tab_wide, tax", "SELECT * FROM tab_wide WHERE feature IN (SELECT feature FROM tax WHERE \"Phylum\" IS NULL)"))
register("subset_features_exclude", lambda s, d: rel.subset_features(fx.tab_wide(s, d), fx.tax(s, d).where("Phylum is null"), True), sql("tab_wide, tax", "SELECT * FROM tab_wide WHERE feature NOT IN (SELECT feature FROM tax WHERE \"Phylum\" IS NULL)"))

SCORE = {"sum": "100 * SUM(p)", "mean": "100 * SUM(p) / n", "max": "100 * MAX(p)", "frequency": "100.0 * COUNT(*) / n"}
for method in SCORE:
    register(
        f"subset_abundant_{method}_top25",
        lambda s, d, method=method: rel.subset_abundant(fx.tab_wide(s, d), 25, method),
        sql("tab_wide", f"SELECT * FROM tab_wide WHERE feature IN (SELECT feature FROM sc ORDER BY ROUND(score, 10) DESC, feature LIMIT 25)", p=P.format(tab="tab_wide"), sc=f"SELECT feature, {SCORE[method]} score FROM p, (SELECT COUNT(DISTINCT sample) n FROM p) GROUP BY feature, n"),
    )
register(
    "subset_abundant_cutoff",
    lambda s, d: rel.subset_abundant(fx.tab_small(s, d), method="max", cutoff=7.0),
    sql("tab_small", "SELECT * FROM tab_small WHERE feature IN (SELECT feature FROM p GROUP BY feature HAVING 100 * MAX(p) >= 7.0)", p=P.format(tab="tab_small")),
)
register("subset_taxa_contains", lambda s, d: fx.tax(s, d).where(rel.taxa_match(fx.tax(s, d), ["brand#1", "x_2"])), sql("tax", "SELECT * FROM tax WHERE COALESCE(regexp_matches(\"Domain\", '(?i)brand#1|x_2'), FALSE) OR COALESCE(regexp_matches(\"Phylum\", '(?i)brand#1|x_2'), FALSE) OR COALESCE(regexp_matches(\"Genus\", '(?i)brand#1|x_2'), FALSE)"))
register("subset_taxa_regex_exclude", lambda s, d: rel.subset_taxa(fx.tab_wide(s, d), fx.tax(s, d), "^p__brand#[1-3]", "phylum", exclude=True, regex=True, tasks=fx.tasks(s, d)), sql("tab_wide, tax", "SELECT t.* FROM tab_wide t JOIN tax USING (feature) WHERE NOT COALESCE(regexp_matches(\"Phylum\", '(?i)^p__brand#[1-3]'), FALSE)"))
register("subset_taxa_fullmatch", lambda s, d: fx.tax(s, d).where(rel.taxa_match(fx.tax(s, d), ["1x_0", "2x_1"], "Genus", match_type="fullmatch")), sql("tax", "SELECT * FROM tax WHERE \"Genus\" IN ('1x_0', '2x_1')"))
register("subset_taxa_na", lambda s, d: fx.tax(s, d).where(rel.taxa_match(fx.tax(s, d), "P__Brand#2", "Phylum", match_type="startswith", case=True, na=True)).select("feature"), sql("tax", "SELECT feature FROM tax WHERE \"Phylum\" IS NULL OR TRIM(\"Phylum\") = '' OR starts_with(\"Phylum\", 'P__Brand#2')"))

# -- merging and naming

register("merge_samples_sum", lambda s, d: rel.merge_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), "region"), sql("tab_wide, supplier_meta", "SELECT feature, region sample, SUM(value) value FROM tab_wide JOIN supplier_meta USING (sample) GROUP BY ALL"))
register("merge_samples_mean", lambda s, d: rel.merge_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), ["region", "nation"], method="mean", tasks=fx.tasks(s, d)), sql("tab_wide, supplier_meta", f"SELECT feature, region || '-' || nation sample, {r('SUM(value) / n', 'value')} FROM tab_wide JOIN supplier_meta USING (sample) JOIN (SELECT region, nation, COUNT(*) n FROM supplier_meta GROUP BY ALL) USING (region, nation) GROUP BY feature, region, nation, n"))
register(
    "merge_samples_weighted",
    lambda s, d: rel.merge_samples(fx.tab_small(s, d), fx.nation_meta(s, d), "region", weight="n_suppliers"),
    sql("tab_small, nation_meta", f"SELECT feature, region sample, {r('SUM(value * n_suppliers / w)', 'value')} FROM tab_small JOIN nation_meta USING (sample) JOIN (SELECT region, SUM(n_suppliers) w FROM nation_meta GROUP BY 1) USING (region) GROUP BY feature, region"),
)
register("merge_samples_values", lambda s, d: rel.merge_samples(fx.tab_wide(s, d), fx.supplier_meta(s, d), "region", values=["AFRICA", "ASIA"]), sql("tab_wide, supplier_meta", "SELECT feature, region sample, SUM(value) value FROM tab_wide JOIN supplier_meta USING (sample) WHERE region IN ('AFRICA', 'ASIA') GROUP BY ALL"))
register("merge_meta", lambda s, d: rel.merge_meta(fx.supplier_meta(s, d), "region", "mean"), sql("supplier_meta", f"SELECT region sample, COUNT(*) n_samples, arg_min(nation, sample) nation, {r('AVG(acctbal)', 'acctbal')} FROM supplier_meta GROUP BY region"))
register("rename_features", lambda s, d: rel.rename_features(fx.tab_wide(s, d), rel.rename_map(fx.tab_wide(s, d))), sql("tab_wide", "SELECT 'OTU' || rk feature, sample, value FROM tab_wide JOIN (SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(100 * SUM(p), 10) DESC, feature) rk FROM p GROUP BY feature) USING (feature)", p=P.format(tab="tab_wide")))
register("natural_sort", lambda s, d: rel.with_order(fx.tab_wide(s, d).select(F.concat(F.lit("ASV"), "feature").alias("feature"))), sql("tab_wide", "SELECT 'ASV' || feature feature, ROW_NUMBER() OVER (ORDER BY CAST(feature AS INT)) ord FROM (SELECT DISTINCT feature FROM tab_wide)"))
register("summary", lambda s, d: rel.summary(fx.tab_wide(s, d)), sql("tab_wide", "SELECT (SELECT COUNT(DISTINCT feature) FROM tab_wide) features, COUNT(*) samples, SUM(v) total, MIN(v) smallest, MAX(v) largest FROM (SELECT sample, SUM(value) v FROM tab_wide GROUP BY 1)"))
register(
    "validate_orphans",
    lambda s, d: rel.faults(fx.tab_wide(s, d), fx.tax(s, d).where("cast(feature as int) % 50 <> 0"), fx.tree_large(s, d).where("node <> 'root' and node not like '%7'")),
    sql(
        "tab_wide, tree_large", "SELECT 'feature without taxonomy' AS rule, feature id FROM f WHERE CAST(feature AS INT) % 50 = 0 UNION ALL SELECT 'feature outside of the tree', feature FROM f WHERE feature LIKE '%7' UNION ALL SELECT 'parent that does not exist', parent FROM (SELECT DISTINCT parent FROM t) WHERE parent NOT IN (SELECT node FROM t) AND parent IS NOT NULL",
        f="SELECT DISTINCT feature FROM tab_wide", t="SELECT * FROM tree_large WHERE node <> 'root' AND node NOT LIKE '%7'",
    ),
)
register(
    "summarize_taxa",
    lambda s, d: rel.summarize_taxa(fx.tab_wide(s, d), fx.tax(s, d).join(fx.tab_wide(s, d).select("feature").distinct(), "feature"), fx.tasks(s, d)),
    sql(
        "tab_wide, tax", 'SELECT sample, COUNT(*) features, SUM(value) reads, COUNT(DISTINCT "Domain") "Domain", COUNT(DISTINCT "Phylum") "Phylum", COUNT(DISTINCT "Genus") "Genus" FROM tab_wide JOIN tax USING (feature) GROUP BY sample UNION ALL SELECT \'Total\', COUNT(*), (SELECT SUM(value) FROM tab_wide), COUNT(DISTINCT "Domain"), COUNT(DISTINCT "Phylum"), COUNT(DISTINCT "Genus") FROM tax WHERE feature IN (SELECT feature FROM tab_wide)',
    ),
)

# -- taxonomy

register(
    "clean_taxonomy",
    lambda s, d: taxonomy.clean_taxonomy(fx.tax(s, d)),
    sql(
        "tax",
        "SELECT feature, \"Domain\", CASE WHEN \"Phylum\" IS NULL OR LOWER(TRIM(\"Phylum\")) = 'unknown' THEN NULL ELSE regexp_replace('p__' || SUBSTR(\"Phylum\", 4), '_\\d+$', '') END \"Phylum\", CASE WHEN \"Genus\" IS NULL OR \"Genus\" = '' THEN NULL ELSE regexp_replace('g__' || \"Genus\", '_\\d+$', '') END \"Genus\" FROM tax",
    ),
)
register("tax_prefix_add", lambda s, d: taxonomy.tax_prefix(fx.tax(s, d)), sql("tax", "SELECT feature, \"Domain\", CASE WHEN \"Phylum\" IS NOT NULL AND NOT contains(\"Phylum\", '__') AND LENGTH(\"Phylum\") > 1 THEN 'p__' || \"Phylum\" ELSE \"Phylum\" END \"Phylum\", CASE WHEN LENGTH(\"Genus\") > 1 THEN 'g__' || \"Genus\" ELSE \"Genus\" END \"Genus\" FROM tax"))
register("tax_prefix_remove", lambda s, d: taxonomy.tax_prefix(fx.tax(s, d), add=False), sql("tax", "SELECT feature, SUBSTR(\"Domain\", 4) \"Domain\", CASE WHEN contains(\"Phylum\", '__') THEN SUBSTR(\"Phylum\", 4) ELSE \"Phylum\" END \"Phylum\", \"Genus\" FROM tax"))

FILL = "SELECT feature, d, CASE WHEN \"Phylum\" IS NULL OR LENGTH(\"Phylum\") < 4 THEN CASE WHEN contains(LOWER(d), 'unclassified') THEN d ELSE d || ' unclassified' END ELSE \"Phylum\" END p, \"Genus\" g FROM (SELECT *, CASE WHEN \"Domain\" IS NULL OR TRIM(\"Domain\") = '' THEN 'd__Unclassified' ELSE \"Domain\" END d FROM tax)"
FILL2 = "SELECT feature, d, p, CASE WHEN g IS NULL OR LENGTH(g) < 4 THEN CASE WHEN contains(LOWER(p), 'unclassified') THEN p ELSE p || ' unclassified' END ELSE g END g FROM f1"
register("groupbytaxa", lambda s, d: taxonomy.group_by_taxa(fx.tab_wide(s, d), fx.tax(s, d), ["Phylum", "Genus"], fx.tasks(s, d)), sql("tab_wide, tax", "SELECT CASE WHEN p = g THEN p ELSE p || '; ' || g END name, sample, SUM(value) value FROM tab_wide JOIN f2 USING (feature) GROUP BY ALL", f1=FILL, f2=FILL2))
TOP = "SELECT name FROM (SELECT name, ROUND(MAX(v), 8) s FROM nm GROUP BY name) ORDER BY s DESC, name LIMIT 10"
RA = "SELECT n.name, s.sample, COALESCE(v, 0) pct FROM top n CROSS JOIN (SELECT DISTINCT sample FROM nm) s LEFT JOIN nm ON nm.name = n.name AND nm.sample = s.sample"
_ra = {"p": "SELECT feature, sample, 100 * value / SUM(value) OVER (PARTITION BY sample) v FROM (SELECT feature, region sample, SUM(value) value FROM tab_wide JOIN supplier_meta USING (sample) GROUP BY ALL)", "f1": FILL, "nm": "SELECT f1.p AS name, sample, SUM(v) v FROM p JOIN f1 USING (feature) GROUP BY ALL", "top": TOP, "ra": RA}
register("ra_table_topn", lambda s, d: taxonomy.top_taxa(fx.tab_wide(s, d), fx.tax(s, d), "Phylum", fx.regions(fx.supplier_meta(s, d)), 10), sql("tab_wide, tax, supplier_meta", f"SELECT name, sample, {r('pct', 'pct')} FROM ra", **_ra))
register("pie_other", lambda s, d: taxonomy.with_other(taxonomy.top_taxa(fx.tab_wide(s, d), fx.tax(s, d), "Phylum", fx.regions(fx.supplier_meta(s, d)), 10)), sql("tab_wide, tax, supplier_meta", f"SELECT name, sample, {r('pct', 'pct')} FROM ra UNION ALL SELECT 'Other', sample, {r('100 - SUM(pct)', 'pct')} FROM ra GROUP BY sample", **_ra))

# -- parsers, on lines made from the part table

register(
    "parse_gtdb",
    lambda s, d: text.parse_gtdb(fx.lineage(s, d), "feature", "lineage"),
    sql("lineage", "SELECT feature, regexp_extract(lineage, 'd__([^;]*)', 1) \"Domain\", regexp_extract(lineage, 'p__([^;]*)', 1) \"Phylum\", NULL::VARCHAR \"Class\", NULL::VARCHAR \"Order\", NULL::VARCHAR \"Family\", regexp_extract(lineage, 'g__([^;]*)', 1) \"Genus\", NULL::VARCHAR \"Species\" FROM lineage"),
)
register(
    "parse_qiime",
    lambda s, d: text.parse_qiime(fx.lineage(s, d), "feature", "lineage"),
    sql("lineage", "SELECT feature, regexp_extract(lineage, 'd__([^;]*)', 1) \"Domain\", regexp_extract(lineage, 'p__([^;]*)', 1) \"Phylum\", '' \"Class\", '' \"Order\", '' \"Family\", regexp_extract(lineage, 'g__([^;]*)', 1) \"Genus\", '' \"Species\" FROM lineage"),
)
register(
    "parse_sintax",
    lambda s, d: text.parse_sintax(fx.lineage(s, d).select("feature", F.concat(F.lit("d:X(1.00)\t+\td:Bac,p:"), F.regexp_replace(F.split("lineage", ";")[1], "^p__", ""), F.lit(",g:G"), "feature").alias("text"))),
    "SELECT CAST(p_partkey AS VARCHAR) feature, 'd__Bac' \"Domain\", 'p__' || p_brand \"Phylum\", NULL::VARCHAR \"Class\", NULL::VARCHAR \"Order\", NULL::VARCHAR \"Family\", 'g__G' || p_partkey \"Genus\", NULL::VARCHAR \"Species\" FROM part",
)


def _coverm(s, d):
    p = fx.tab_wide(s, d)
    cells = F.array(F.struct(F.lit("ra").alias("measure"), F.col("value").alias("value")), F.struct(F.lit("bases").alias("measure"), (F.col("value") * 2).alias("value")), F.struct(F.lit("length").alias("measure"), F.lit(50.0).alias("value")))
    return text.coverm_table(p.select("feature", "sample", F.inline(cells)), 0.5)[0]


register("coverm_threshold", _coverm, sql("tab_wide", "SELECT feature, sample, value FROM tab_wide WHERE value * 2 / 50 >= 0.5"))
register(
    "ebd_lineage",
    lambda s, d: text.ebd_tables(fx.lineage(s, d).select(F.lit("s1").alias("sample"), F.concat(F.lit("Root; "), F.regexp_replace("lineage", ";", "; "), F.lit("; None")).alias("lineage"), F.col("feature").cast("int").alias("ord"), F.lit(1.0).alias("value")))[1],
    sql("lineage", "SELECT 'OTU' || ROW_NUMBER() OVER (ORDER BY CAST(feature AS INT)) feature, string_split(lineage, ';')[1] \"Domain\", string_split(lineage, ';')[2] \"Phylum\", string_split(lineage, ';')[3] \"Class\", NULL::VARCHAR \"Order\", NULL::VARCHAR \"Family\", NULL::VARCHAR \"Genus\", NULL::VARCHAR \"Species\" FROM lineage"),
)


def _type_trees(s, d):
    """A tree for each type, of brands and their parts, as text."""
    p = fx.read(s, d, "part").select("p_type", "p_brand", F.concat(F.col("p_partkey").cast("string"), F.lit(":0."), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("tip"))
    clades = p.groupBy("p_type", "p_brand").agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("tip")), ","), F.lit(")'"), F.col("p_brand"), F.lit("':0.5")).alias("clade"))
    return clades.groupBy("p_type").agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("clade")), ","), F.lit(")'"), F.col("p_type"), F.lit("';")).alias("newick"))


register(
    "parse_newick_column",
    lambda s, d: newick.parse_column(_type_trees(s, d)),
    f"SELECT p_type, CAST(p_partkey AS VARCHAR) node, p_brand parent, {r('CAST(p_size AS DOUBLE) / 100', 'branchL')}, {r('0.5::DOUBLE + CAST(p_size AS DOUBLE) / 100', 'dist_to_root')} FROM part UNION ALL SELECT DISTINCT p_type, p_brand, p_type, 0.5::DOUBLE, 0.5::DOUBLE FROM part UNION ALL SELECT DISTINCT p_type, p_type, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM part",
)
register(
    "fasta_text",
    lambda s, d: text.fasta_records(fx.seq(s, d).select(F.concat("feature", F.lit(";size=3\n"), F.substring("seq", 1, 6), F.lit("\n"), F.expr("substring(seq, 7)"), F.lit("\n")).alias("value")), ";"),
    sql("seq", "SELECT feature, replace(seq, ' ', '') seq FROM seq"),
)

# -- thinning and views

READS = "SELECT feature, sample, UNNEST(RANGE(1, CAST(value AS BIGINT) + 1)) i FROM {tab}"
RN = f"SELECT feature, sample, ROW_NUMBER() OVER (PARTITION BY sample ORDER BY {md5('7', 'sample', 'feature', 'i')}, feature, i) rn FROM reads"
register(
    "rarefy_min",
    lambda s, d: rel.rarefy(fx.tab_wide(s, d), "min", 7),
    sql("tab_wide", "SELECT feature, sample, CAST(COUNT(*) AS DOUBLE) value FROM rn, (SELECT MIN(t) m FROM (SELECT SUM(value) t FROM tab_wide GROUP BY sample)) WHERE rn <= m GROUP BY feature, sample", reads=READS.format(tab="tab_wide"), rn=RN),
)
register(
    "rarefy_depth",
    lambda s, d: rel.rarefy(fx.tab_wide(s, d), 300, 7),
    sql("tab_wide", "SELECT feature, sample, CAST(COUNT(*) AS DOUBLE) value FROM rn JOIN (SELECT sample FROM tab_wide GROUP BY sample HAVING SUM(value) >= 300) USING (sample) WHERE rn <= 300 GROUP BY feature, sample", reads=READS.format(tab="tab_wide"), rn=RN),
)
register(
    "rarefy_replacement",
    lambda s, d: rel.rarefy(fx.tab_wide(s, d), 200, 7, replacement=True),
    sql(
        "tab_wide", "SELECT feature, sample, CAST(COUNT(*) AS DOUBLE) value FROM dr JOIN c USING (sample) WHERE a >= lo AND a < hi GROUP BY feature, sample",
        c="SELECT feature, sample, SUM(value) OVER w - value lo, SUM(value) OVER w hi FROM tab_wide WINDOW w AS (PARTITION BY sample ORDER BY feature)",
        dr=f"SELECT sample, FLOOR({u('7', 'sample', 'i')} * t) a FROM (SELECT sample, t, UNNEST(RANGE(1, 201)) i FROM (SELECT sample, SUM(value) t FROM tab_wide GROUP BY sample) WHERE t >= 200)",
    ),
)
register(
    "rarefaction_curve",
    lambda s, d: rel.rarefaction_curve(fx.tab_wide(s, d, "sample"), 1, 7),
    sql(
        "tab_wide",
        f"SELECT sample, depth, {r('EXP(-SUM(n / depth * LN(n / depth)))', 'd')} FROM (SELECT g.sample, depth, feature, CAST(COUNT(*) AS DOUBLE) n FROM rn JOIN g ON g.sample = rn.sample AND rn <= depth GROUP BY ALL) GROUP BY sample, depth UNION ALL SELECT sample, UNNEST([0, 1]), UNNEST([0.0::DOUBLE, 1.0::DOUBLE]) FROM (SELECT DISTINCT sample FROM tab_wide)",
        reads=READS.format(tab="tab_wide"), rn=RN,
        g="SELECT sample, UNNEST(RANGE(st, t, st)) depth FROM (SELECT sample, CAST(SUM(value) AS BIGINT) t, GREATEST(1, CAST(SUM(value) AS BIGINT) // 20) st FROM tab_wide GROUP BY sample) UNION ALL SELECT sample, CAST(SUM(value) AS BIGINT) FROM tab_wide GROUP BY sample",
    ),
)
_START = "SELECT sample, UNNEST([0, 1]), UNNEST([0.0::DOUBLE, 1.0::DOUBLE]) FROM (SELECT DISTINCT sample FROM tab_small)"
_CURVE = {
    "reads": READS.format(tab="tab_small"), "rn": RN,
    "g": "SELECT sample, UNNEST(RANGE(st, t, st)) depth FROM (SELECT sample, CAST(SUM(value) AS BIGINT) t, GREATEST(1, CAST(SUM(value) AS BIGINT) // 20) st FROM tab_small GROUP BY sample) UNION ALL SELECT sample, CAST(SUM(value) AS BIGINT) FROM tab_small GROUP BY sample",
    "p": "SELECT sample, depth, feature, n / depth p FROM (SELECT g.sample, depth, feature, CAST(COUNT(*) AS DOUBLE) n FROM rn JOIN g ON g.sample = rn.sample AND rn <= depth GROUP BY ALL)",
}
register(
    "rarefaction_curve_phyl",
    lambda s, d: rel.rarefaction_curve(fx.tab_small(s, d), 1, 7, div_type="phyl", tree=fx.tree_small(s, d), node_leaf=fx.leaves_small(s, d)),
    sql(
        "tab_small, tree_small, leaves_small", f"SELECT sample, depth, {r('EXP(-SUM(branchL * a * LN(a)) / SUM(branchL * a))', 'd')} FROM a GROUP BY sample, depth UNION ALL {_START}",
        **_CURVE, a="SELECT node, sample, depth, branchL, SUM(p) a FROM p JOIN leaves_small ON leaf = feature JOIN tree_small USING (node) GROUP BY ALL",
    ),
)
register(
    "rarefaction_curve_func",
    lambda s, d: rel.rarefaction_curve(fx.tab_small(s, d), 2, 7, div_type="func", distmat=fx.distmat(s, d)),
    sql(
        "tab_small, distmat", f"SELECT sample, depth, {r('q / s', 'd')} FROM g LEFT JOIN x USING (sample, depth) UNION ALL {_START}",
        **_CURVE, x="SELECT a.sample, a.depth, SUM(d * a.p * b.p) q, SUM(d * POW(a.p * b.p, 2)) / SUM(d * a.p * b.p) s FROM p a JOIN p b USING (sample, depth) JOIN distmat ON f1 = a.feature AND f2 = b.feature GROUP BY ALL",
    ),
)
# Draws on counts follow no SQL; what SQL can say of them is in their sums.
_TOTALS = "SELECT sample, SUM(value) t FROM tab_wide GROUP BY sample"


def _held(thin, tab):
    rows = thin.join(tab.withColumnRenamed("value", "whole"), ["feature", "sample"], "left")
    return rows.groupBy("sample").agg(F.sum("value").alias("reads"), F.count_if(~F.coalesce((F.col("value") > 0) & (F.col("value") <= F.col("whole")) & (F.col("value") == F.floor("value")), F.lit(False))).alias("wrong"))


register("rarefy_counts", lambda s, d: rel.rarefy(fx.tab_wide(s, d, "sample"), "min", 7, method="counts"))
register("rarefy_counts_sizes", lambda s, d: _held(rel.rarefy(fx.tab_wide(s, d, "sample"), "min", 7, method="counts"), fx.tab_wide(s, d)), sql("tab_wide", "SELECT sample, m reads, 0 wrong FROM t, (SELECT MIN(t) m FROM t)", t=_TOTALS))
register("rarefy_counts_depth_sizes", lambda s, d: _held(rel.rarefy(fx.tab_wide(s, d, "sample"), 300, 9, method="counts"), fx.tab_wide(s, d)), sql("tab_wide", "SELECT sample, CAST(300 AS DOUBLE) reads, 0 wrong FROM t WHERE t >= 300", t=_TOTALS))
register("rarefaction_curve_counts", lambda s, d: rel.rarefaction_curve(fx.tab_wide(s, d, "sample"), 1, 7, method="counts"))
register(
    "rarefaction_grid_counts",
    lambda s, d: rel.rarefaction_curve(fx.tab_wide(s, d, "sample"), 0, 7, method="counts").groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("depths"), F.max("d").alias("features")),
    sql("tab_wide", "SELECT g.sample, COUNT(*) n, SUM(depth) depths, MAX(f) features FROM g JOIN (SELECT sample, CAST(COUNT(*) AS DOUBLE) f FROM tab_wide GROUP BY sample) USING (sample) GROUP BY g.sample", g="SELECT sample, UNNEST(RANGE(st, t, st)) depth FROM (SELECT sample, CAST(SUM(value) AS BIGINT) t, GREATEST(1, CAST(SUM(value) AS BIGINT) // 20) st FROM tab_wide GROUP BY sample) UNION ALL SELECT sample, UNNEST([CAST(SUM(value) AS BIGINT), 0, 1]) FROM tab_wide GROUP BY sample"),
)
register(
    "octave",
    lambda s, d: rel.octave(fx.tab_wide(s, d)),
    sql("tab_wide", "SELECT s.sample, g.k, COUNT(t.feature) n FROM (SELECT DISTINCT sample FROM tab_wide) s CROSS JOIN (SELECT CAST(UNNEST(RANGE(LEAST(0, lo), hi + 1)) AS INT) k FROM (SELECT MIN(CAST(FLOOR(LOG2(value)) AS INT)) lo, MAX(CAST(FLOOR(LOG2(value)) AS INT)) hi FROM tab_wide)) g LEFT JOIN tab_wide t ON t.sample = s.sample AND FLOOR(LOG2(t.value)) = g.k GROUP BY s.sample, g.k"),
)
register("octave_events", lambda s, d: rel.octave(fx.tab_events(s, d)), sql("tab_events", "SELECT s.sample, g.k, COUNT(t.feature) n FROM (SELECT DISTINCT sample FROM tab_events) s CROSS JOIN (SELECT CAST(UNNEST(RANGE(LEAST(0, lo), hi + 1)) AS INT) k FROM (SELECT MIN(CAST(FLOOR(LOG2(value)) AS INT)) lo, MAX(CAST(FLOOR(LOG2(value)) AS INT)) hi FROM tab_events)) g LEFT JOIN tab_events t ON t.sample = s.sample AND FLOOR(LOG2(t.value)) = g.k GROUP BY s.sample, g.k"))
register("events_alpha", lambda s, d: _alpha(fx.tab_events(s, d)), sql("tab_events", f"SELECT sample, {r(from_sum(f'SUM({term('p', 1)})', 1), 'd')} FROM p GROUP BY sample", p=P.format(tab="tab_events")))


def _alpha(tab):
    from ..operators.alpha import naive_alpha

    return naive_alpha(tab, 1)
