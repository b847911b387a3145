"""What SQL can say of ordination, permutation tests and random tables.

Where a result depends on permutations or on the signs of eigenvectors, the
query is of what does not: observed sums of squares, inertias, and the matrix
that scores must give back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beta, blocked, nulls, ordination, pairwise, simulate
from ..sources import newick
from . import fixtures as fx
from .diversity_queries import DENSE, SPINE, P, dis, from_sum, pos
from .registry import ORACLES, r, register, sql
from .statistics_queries import _NORMAL, BRAY, RCQ, RCQ_N, summary
from .table_queries import u

# -- Euclidean distances: square roots of Bray and Curtis' -----------------------

NUMBERS = ("place", "mean_acctbal")


def _numbers(s, d) -> DataFrame:
    """Nations with two numbers: their key, and what their suppliers have."""
    return fx.nation_meta(s, d).withColumn("place", F.col("sample").cast("double"))


def _roots(s, d) -> DataFrame:
    return beta.bray(fx.tab_small(s, d)).withColumn("value", F.sqrt("value"))


def _gram(scores: DataFrame) -> DataFrame:
    one, two = scores.select(F.col("sample").alias("s1"), "axis", F.col("score").alias("x")), scores.select(F.col("sample").alias("s2"), "axis", F.col("score").alias("y"))
    return one.join(two, "axis").groupBy("s1", "s2").agg(F.sum(F.col("x") * F.col("y")).alias("a"))


_bray = {"p": P.format(tab="tab_small"), "spine": SPINE, "dn": DENSE, "br": BRAY}
_centred = {
    **_bray, "fu": "SELECT s1, s2, -v / 2 a FROM br UNION ALL SELECT s2, s1, -v / 2 FROM br UNION ALL SELECT sample, sample, 0 FROM (SELECT DISTINCT sample FROM p)",
    "g": "SELECT s1, s2, a - AVG(a) OVER (PARTITION BY s1) - AVG(a) OVER (PARTITION BY s2) + AVG(a) OVER () a FROM fu",
}
register("pcoa_gram", lambda s, d: _gram(ordination.pcoa(_roots(s, d))), sql("tab_small", f"SELECT s1, s2, {r('a', 'a')} FROM g", **_centred))
register(
    "pcoa_trace",
    lambda s, d: ordination.pcoa(_roots(s, d)).select("axis", "eigenvalue").distinct().agg(F.sum("eigenvalue").alias("total"), F.count(F.lit(1)).alias("axes")),
    sql("tab_small", f"SELECT {r('SUM(CASE WHEN s1 = s2 THEN a END)', 'total')}, SQRT(COUNT(*))::BIGINT - 1 AS axes FROM g", **_centred),
)

#: Sums of squares of a number (m), of another (b), and of each given the other.
_fits = {
    **_centred, "n": "SELECT COUNT(DISTINCT s1) n, SUM(CASE WHEN s1 = s2 THEN a END) total FROM g",
    "m": "SELECT sample, CAST(sample AS DOUBLE) - AVG(CAST(sample AS DOUBLE)) OVER () x, mean_acctbal - AVG(mean_acctbal) OVER () y FROM nation_meta WHERE sample IN (SELECT s1 FROM g)",
    "e": "SELECT sample, x, y, x - y * (SELECT SUM(x * y) / SUM(y * y) FROM m) xe, y - x * (SELECT SUM(x * y) / SUM(x * x) FROM m) ye FROM m",
    "k": "SELECT SUM(a * p.x * q.x) / (SELECT SUM(x * x) FROM e) sx, SUM(a * p.y * q.y) / (SELECT SUM(y * y) FROM e) sy, SUM(a * p.xe * q.xe) / (SELECT SUM(xe * xe) FROM e) sxe, SUM(a * p.ye * q.ye) / (SELECT SUM(ye * ye) FROM e) sye FROM g JOIN e p ON p.sample = s1 JOIN e q ON q.sample = s2",
}
_rest = "(total - sy - sxe)"
register(
    "permanova_numbers",
    lambda s, d: ordination.permanova(_roots(s, d), _numbers(s, d), NUMBERS, n=0).drop("p"),
    sql(
        "tab_small, nation_meta",
        " UNION ALL ".join(f"SELECT '{t}' term, 1.0::DOUBLE df, {r(v, 'ss')}, {r(v, 'ms')}, {r(f'{v} / ({_rest} / (n - 3))', 'f')}, {r(f'{v} / total', 'r2')} FROM k, n" for t, v in zip(NUMBERS, ("sxe", "sye"), strict=True))
        + f" UNION ALL SELECT 'Residual', CAST(n - 3 AS DOUBLE), {r(_rest, 'ss')}, {r(f'{_rest} / (n - 3)', 'ms')}, NULL, {r(f'{_rest} / total', 'r2')} FROM k, n",
        **_fits,
    ),
)
# The same in blocks, of so few samples that there are several.
register("pcoa_blocked_gram", lambda s, d: _gram(blocked.pcoa(_roots(s, d), 30, size=7)), ORACLES["pcoa_gram"])
register("permanova_blocked_numbers", lambda s, d: blocked.permanova(_roots(s, d), _numbers(s, d), NUMBERS, n=9, size=7).drop("p"), ORACLES["permanova_numbers"])
register("permanova_blocked_freedman_lane", lambda s, d: blocked.permanova(_roots(s, d), _numbers(s, d), NUMBERS, n=9, scheme="freedman-lane", size=7).drop("p"), ORACLES["permanova_numbers"])


def _bray_wide(s: SparkSession, d: str) -> pairwise.Pairs:
    return pairwise.Pairs(fx.tab_wide(s, d, "sample"), pairwise.bray(), beta.bray)


register("pcoa_blocked", lambda s, d: blocked.pcoa(_bray_wide(s, d), 5))
_one = {
    "p": P.format(tab="tab_wide"), "b0": "SELECT a.sample s1, b.sample s2, SUM(LEAST(a.p, b.p)) x FROM p a JOIN p b ON a.feature = b.feature AND a.sample < b.sample GROUP BY ALL",
    "br": "SELECT a.sample s1, b.sample s2, 1 - COALESCE(x, 0) v FROM (SELECT DISTINCT sample FROM p) a JOIN (SELECT DISTINCT sample FROM p) b ON a.sample < b.sample LEFT JOIN b0 ON s1 = a.sample AND s2 = b.sample",
    "sz": "SELECT region, COUNT(*) n FROM supplier_meta WHERE sample IN (SELECT sample FROM p) GROUP BY 1", "wi": "SELECT a.region, SUM(v * v) d2 FROM br JOIN supplier_meta a ON a.sample = s1 JOIN supplier_meta b ON b.sample = s2 AND a.region = b.region GROUP BY ALL",
    "fs": "SELECT SUM(n) n, COUNT(*) k, SUM(COALESCE(d2 / n, 0)) ssw, (SELECT SUM(v * v) FROM br) / SUM(n) sst FROM sz LEFT JOIN wi USING (region)",
}
register(
    "permanova_blocked_regions",
    lambda s, d: blocked.permanova(_bray_wide(s, d), fx.supplier_meta(s, d), "region", n=99, seed=5).drop("p"),
    sql("tab_wide, supplier_meta", f"SELECT 'region' AS term, CAST(k - 1 AS DOUBLE) df, {r('sst - ssw', 'ss')}, {r('(sst - ssw) / (k - 1)', 'ms')}, {r('((sst - ssw) / (k - 1)) / (ssw / (n - k))', 'f')}, {r('(sst - ssw) / sst', 'r2')} FROM fs UNION ALL SELECT 'Residual', CAST(n - k AS DOUBLE), {r('ssw', 'ss')}, {r('ssw / (n - k)', 'ms')}, NULL, {r('ssw / sst', 'r2')} FROM fs", **_one),
)
for _scheme in ("labels", "freedman-lane"):
    register(
        f"permanova_dense_oneway_{_scheme.replace('-', '_')}",
        lambda s, d, scheme=_scheme: ordination.permanova(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), "region", n=19, seed=5, scheme=scheme, strata="n_suppliers").drop("p"),
        sql(
            "tab_small, nation_meta", f"SELECT 'region' AS term, CAST(k - 1 AS DOUBLE) df, {r('sst - ssw', 'ss')}, {r('(sst - ssw) / (k - 1)', 'ms')}, {r('((sst - ssw) / (k - 1)) / (ssw / (n - k))', 'f')}, {r('(sst - ssw) / sst', 'r2')} FROM fs UNION ALL SELECT 'Residual', CAST(n - k AS DOUBLE), {r('ssw', 'ss')}, {r('ssw / (n - k)', 'ms')}, NULL, {r('ssw / sst', 'r2')} FROM fs",
            **_bray, sz="SELECT region, COUNT(*) n FROM nation_meta WHERE sample IN (SELECT sample FROM p) GROUP BY 1", wi="SELECT a.region, SUM(v * v) d2 FROM br JOIN nation_meta a ON a.sample = s1 JOIN nation_meta b ON b.sample = s2 AND a.region = b.region GROUP BY ALL",
            fs="SELECT SUM(n) n, COUNT(*) k, SUM(COALESCE(d2 / n, 0)) ssw, (SELECT SUM(v * v) FROM br) / SUM(n) sst FROM sz LEFT JOIN wi USING (region)",
        ),
    )


def _dbrda(part: str, **how):
    return lambda s, d: ordination.dbrda(_roots(s, d), _numbers(s, d), n=0, **how)[part]


register("dbrda_numbers_terms", _dbrda("terms", by=NUMBERS), sql("tab_small, nation_meta", f"SELECT 'place' term, {r('sxe', 'inertia')}, {r('100 * sxe / (sxe + sye)', 'percent')} FROM k UNION ALL SELECT 'mean_acctbal', {r('sye', 'inertia')}, {r('100 * sye / (sxe + sye)', 'percent')} FROM k", **_fits))
register(
    "dbrda_numbers_test",
    lambda s, d: _dbrda("test", by=NUMBERS)(s, d).drop("p"),
    sql("tab_small, nation_meta", f"SELECT {r('sy + sxe', 'constrained')}, {r('total', 'total')}, {r('(sy + sxe) / total', 'r2')}, {r(f'((sy + sxe) / 2) / ({_rest} / (n - 3))', 'f')} FROM k, n", **_fits),
)
register(
    "dbrda_numbers_partial",
    lambda s, d: _dbrda("test", by=["place"], condition=["mean_acctbal"])(s, d).drop("p"),
    sql("tab_small, nation_meta", f"SELECT {r('sxe', 'constrained')}, {r('total - sy', 'total')}, {r('sxe / (total - sy)', 'r2')}, {r(f'sxe / ({_rest} / (n - 3))', 'f')} FROM k, n", **_fits),
)
register("dbrda_numbers_axes", lambda s, d: _dbrda("axes", by=NUMBERS)(s, d).agg(F.sum("eigenvalue").alias("constrained"), F.sum("percent").alias("percent"), F.count(F.lit(1)).alias("axes")), sql("tab_small, nation_meta", f"SELECT {r('sy + sxe', 'constrained')}, 100.0::DOUBLE percent, 2::BIGINT axes FROM k", **_fits))
register(
    "dbrda_numbers_marginal",
    lambda s, d: ordination.dbrda_marginal(_roots(s, d), _numbers(s, d), NUMBERS, n=0).select("term", "df", "f", "f_alone"),
    sql("tab_small, nation_meta", " UNION ALL ".join(f"SELECT '{t}' term, 1.0::DOUBLE df, {r(f'{v} / ({_rest} / (n - 3))', 'f')}, {r(f'{w} / ((total - {w}) / (n - 2))', 'f_alone')} FROM k, n" for t, v, w in zip(NUMBERS, ("sxe", "sye"), ("sx", "sy"), strict=True)), **_fits),
)


def _given_scores(s, d) -> DataFrame:
    """Two numbers of a nation in place of its scores."""
    return fx.nation_meta(s, d).select("sample", F.explode(F.array(F.struct(F.lit(1).alias("axis"), (F.col("mean_acctbal") / 1000).alias("score")), F.struct(F.lit(2).alias("axis"), F.col("n_suppliers").cast("double").alias("score")))).alias("x")).select("sample", "x.axis", "x.score")


register(
    "ellipse_of_scores",
    lambda s, d: ordination.ellipse(_given_scores(s, d), fx.regions(fx.nation_meta(s, d))),
    sql(
        "nation_meta", f"SELECT grp, {r('x', 'x')}, {r('y', 'y')}, {r('4 * SQRT(h + q)', 'width')}, {r('4 * SQRT(GREATEST(0, h - q))', 'height')}, {r('DEGREES(ATAN2(h + q - va, c))', 'angle')} FROM e",
        m="SELECT region grp, AVG(a) x, AVG(b) y, VAR_SAMP(a) va, VAR_SAMP(b) vb, COVAR_SAMP(a, b) c FROM (SELECT region, mean_acctbal / 1000 a, CAST(n_suppliers AS DOUBLE) b FROM nation_meta) GROUP BY 1 HAVING COUNT(*) > 2", e="SELECT *, (va + vb) / 2 h, SQRT(POW((va - vb) / 2, 2) + c * c) q FROM m",
    ),
)
register(
    "biplot_of_scores",
    lambda s, d: ordination.biplot(_given_scores(s, d), fx.nation_meta(s, d).select("sample", F.lit("mean_acctbal").alias("variable"), F.col("mean_acctbal").alias("value"))),
    sql("nation_meta", f"SELECT 'mean_acctbal' AS variable, axis::INT axis, {r('COVAR_SAMP(v, x) / STDDEV_SAMP(v)', 'score')} FROM (SELECT mean_acctbal v, UNNEST([1, 2]) axis, UNNEST([mean_acctbal / 1000, CAST(n_suppliers AS DOUBLE)]) x FROM nation_meta) GROUP BY axis"),
)

# -- random tables -----------------------------------------------------------------

_TABLES = {k: v.replace("tab_wide", "tab_small").replace("supplier_meta", "nation_meta").replace(") / fr,", ") / ab,") for k, v in RCQ.items()}
_NODES = "SELECT it, node feature, branchL, sample, SUM(p) p FROM p JOIN leaves_small ON leaf = feature JOIN tree_small USING (node) GROUP BY ALL"
_NODE_PAIRS = "SELECT it, s1, s2, feature, branchL, SUM(CASE WHEN sample = s1 THEN p ELSE 0 END) x1, SUM(CASE WHEN sample = s2 THEN p ELSE 0 END) x2 FROM spine JOIN a ON a.sample IN (s1, s2) GROUP BY ALL"
_height = "SUM(branchL * (x1 + x2) / 2)"
_phyl = f"SELECT it, s1, s2, {dis('b', 1, '2.0', 'phyl', 'regional')} x FROM (SELECT it, s1, s2, {from_sum('SUM(branchL * ' + pos('(x1 + x2) / 2', 1) + ') / ' + _height, 1)} / {from_sum('(SUM(branchL * (' + pos('x1', 1) + ' + ' + pos('x2', 1) + ')) / 2) / (' + _height + ')', 1)} b FROM np GROUP BY it, s1, s2)"
_func = {
    "y": "SELECT a.it, a.s1, a.s2, d, (a.x1 + a.x2) / 2 m1, (b.x1 + b.x2) / 2 m2, a.x1 a1, a.x2 a2, b.x1 b1, b.x2 b2 FROM dn a JOIN dn b ON a.it = b.it AND a.s1 = b.s1 AND a.s2 = b.s2 JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature",
    "x": f"SELECT it, s1, s2, {dis('POW(g / a, 2)', 1, '2.0', 'func', 'regional')} x FROM (SELECT it, s1, s2, {from_sum('gs / q', 1, 2.0)} g, {from_sum('al / q', 1, 2.0)} / 2 a FROM (SELECT it, s1, s2, SUM(d * m1 * m2) q, SUM(d * {pos('m1 * m2', 1)}) gs, SUM(d * ({pos('a1 * b1 / 4', 1)} + {pos('a2 * b2 / 4', 1)} + {pos('a1 * b2 / 4', 1)} + {pos('a2 * b1 / 4', 1)})) al FROM y GROUP BY it, s1, s2))",
}


def _rcq(kind: str):
    return lambda s, d: nulls.rcq(fx.tab_small(s, d), kind, 1, RCQ_N, fx.regions(fx.nation_meta(s, d)), "abundance", 5, fx.tree_small(s, d), fx.leaves_small(s, d), fx.distmat(s, d))


register("rcq_phyl", _rcq("phyl"), sql("tab_small, nation_meta, tree_small, leaves_small", summary("s1, s2", "x", RCQ_N), **_TABLES, a=_NODES, np=_NODE_PAIRS, x=_phyl))
register("rcq_func", _rcq("func"), sql("tab_small, nation_meta, distmat", summary("s1, s2", "x", RCQ_N), **_TABLES, **_func))
register(
    "community_sample",
    lambda s, d: simulate.community_sample(simulate.simulate_community(s, 30, 3, seed=5), 500, 5),
    sql(
        "", "SELECT feature, sample, CAST(COUNT(*) AS DOUBLE) value FROM dr JOIN ce USING (sample) WHERE a >= lo AND a < hi GROUP BY feature, sample",
        c=f"SELECT feature, sample, 100 * x / SUM(x) OVER (PARTITION BY sample) v FROM (SELECT feature, sample, EXP(0.0::DOUBLE + 1.0::DOUBLE * {_NORMAL}) x FROM (SELECT 'SP' || UNNEST(RANGE(1, 31)) feature), (SELECT 'C' || UNNEST(RANGE(1, 4)) sample))",
        ce="SELECT feature, sample, SUM(v) OVER w - v lo, SUM(v) OVER w hi FROM c WINDOW w AS (PARTITION BY sample ORDER BY feature)",
        dr=f"SELECT sample, {u('5', 'sample', 'i')} * t a FROM (SELECT sample, SUM(v) t FROM c GROUP BY sample), (SELECT UNNEST(RANGE(1, 501)) i)",
    ),
)

# -- trees --------------------------------------------------------------------------


def _rows(s, d) -> list[tuple]:
    return [tuple(x) for x in fx.tree_small(s, d).orderBy(F.col("parent").isNotNull(), "node").collect()]


register(
    "tree_layout",
    lambda s, d: s.createDataFrame(newick.layout(newick.ladderize(newick.from_rows(_rows(s, d)))), "node string, x double, y double"),
    sql(
        "tree_small", f"SELECT node, 1.0::DOUBLE x, {r('y', 'y')} FROM t UNION ALL SELECT parent, 0.7::DOUBLE, {r('AVG(y)', 'y')} FROM t GROUP BY parent UNION ALL SELECT 'root', 0.0::DOUBLE, {r('AVG(y)', 'y')} FROM (SELECT AVG(y) y FROM t GROUP BY parent)",
        t="SELECT node, parent, CAST(ROW_NUMBER() OVER (ORDER BY n, parent, node) - 1 AS DOUBLE) y FROM (SELECT node, parent, COUNT(*) OVER (PARTITION BY parent) n FROM tips_small)",
    ),
)
