"""Null models, statistics, ordination, sequences and simulators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alpha, beta, combine, nulls, ordination, sequences, simulate
from ..operators import statistics as st
from ..operators.relational import dealt, settled
from . import fixtures as fx
from .diversity_queries import DENSE, SPINE, P
from .registry import r, register, sql
from .table_queries import md5, u

ITERATIONS = 8


def summary(keys: str, values: str, n: int = ITERATIONS) -> str:
    """The oracle's summary of (it, keys, x) against iteration 0."""
    using = keys
    return (
        f"SELECT {keys}, {r('o', 'obs')}, {r('AVG(x)', 'null_mean')}, {r('STDDEV_SAMP(x)', 'null_std')}, {r(f'(SUM(CASE WHEN ROUND(x, 10) < ROUND(o, 10) THEN 1.0::DOUBLE ELSE 0 END) + 0.5::DOUBLE * SUM(CASE WHEN ROUND(x, 10) = ROUND(o, 10) THEN 1 ELSE 0 END)) / {n}', 'p')}, "
        f"{r('CASE WHEN ROUND(STDDEV_SAMP(x), 10) > 0 THEN (AVG(x) - o) / STDDEV_SAMP(x) END', 'ses')} FROM {values} v JOIN (SELECT {keys}, x o FROM {values} WHERE it = 0) USING ({using}) WHERE it > 0 GROUP BY {keys}, o"
    )


MOVED = f"SELECT a.it, a.feature, b.feature t FROM (SELECT it, feature, ROW_NUMBER() OVER (PARTITION BY it ORDER BY feature) k FROM f, i) a JOIN (SELECT it, feature, ROW_NUMBER() OVER (PARTITION BY it ORDER BY {md5('5', 'it', 'feature')}, feature) k FROM f, i) b USING (it, k)"
MOVED_IN = f"SELECT a.it, a.sample, a.feature, b.feature t FROM (SELECT it, sample, feature, ROW_NUMBER() OVER (PARTITION BY it, sample ORDER BY feature) k FROM f, i, s) a JOIN (SELECT it, sample, feature, ROW_NUMBER() OVER (PARTITION BY it, sample ORDER BY {md5('5', 'it', 'sample', 'feature')}, feature) k FROM f, i, s) b USING (it, sample, k)"


def null_ctes(randomization: str, q: float, tab: str = "tab_small", n: int = ITERATIONS) -> dict[str, str]:
    w = f"SELECT feature, sample, POW(p, {q}) w FROM p"
    return {
        "p": P.format(tab=tab), "f": "SELECT DISTINCT feature FROM p", "s": "SELECT DISTINCT sample FROM p", "i": f"SELECT UNNEST(RANGE(1, {n + 1})) it", "w0": w, "mv": MOVED if randomization == "features" else MOVED_IN,
        "w": "SELECT 0::BIGINT it, feature, sample, w FROM w0 UNION ALL SELECT it, t, sample, w FROM w0 JOIN mv USING (" + ("feature" if randomization == "features" else "feature, sample") + ")",
    }


WW = "w a JOIN w b ON a.it = b.it AND {cond} JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature"


def _null_queries(rand: str, n: int, suffix: str = "", arrays: bool = False, kinds: str = "nri nti beta_nri beta_nti") -> None:
    """Relatedness against ``n`` iterations; by moments if ``arrays``."""
    ctes = null_ctes(rand, 1, n=n) | {"z": "SELECT it, sample, SUM(w) z FROM w GROUP BY ALL"}
    near = "SELECT n.it, s1, s2, SUM(w * near) / z v FROM (SELECT a.it, a.sample s1, b.sample s2, a.feature, a.w, MIN(d) near FROM " + WW.format(cond="a.sample <> b.sample") + " GROUP BY ALL) n JOIN z ON z.it = n.it AND z.sample = s1 GROUP BY n.it, s1, s2, z"
    values = {
        "nri": ("sample", {"x": "SELECT a.it, a.sample, SUM(a.w * b.w * d) / SUM(a.w * b.w) x FROM " + WW.format(cond="a.sample = b.sample") + " GROUP BY ALL"}),
        "nti": ("sample", {"x": "SELECT it, sample, SUM(w * near) / SUM(w) x FROM (SELECT a.it, a.sample, a.feature, a.w, MIN(d) near FROM " + WW.format(cond="a.sample = b.sample") + " GROUP BY ALL) GROUP BY ALL"}),
        "beta_nri": ("s1, s2", {"x": "SELECT g.it, s1, s2, g / (a.z * b.z) x FROM (SELECT a.it, a.sample s1, b.sample s2, SUM(a.w * b.w * d) g FROM " + WW.format(cond="a.sample < b.sample") + " GROUP BY ALL) g JOIN z a ON a.it = g.it AND a.sample = s1 JOIN z b ON b.it = g.it AND b.sample = s2"}),
        "beta_nti": ("s1, s2", {"v": near, "x": "SELECT it, LEAST(s1, s2) s1, GREATEST(s1, s2) s2, SUM(v) / 2 x FROM v GROUP BY ALL"}),
    }
    for kind in kinds.split():
        keys, parts = values[kind]
        register(
            f"{kind}_{rand}{suffix}",
            lambda s, d, kind=kind: getattr(nulls, kind)(fx.tab_small(s, d), fx.distmat(s, d), 1, n, rand, seed=5, arrays=arrays),
            sql("tab_small, distmat", summary(keys, "x", n), **ctes, **parts),
        )


for rand in ("features", "abundances"):
    _null_queries(rand, ITERATIONS)
    _null_queries(rand, 99, "_99", True, "beta_nri beta_nti")
    _null_queries(rand, 999, "_999", True, "nri nti")

RCQ_N = 4
RCQ = {
    "i": f"SELECT UNNEST(RANGE(1, {RCQ_N + 1})) it",
    "pool": "SELECT region grp, feature, SUM(value) ab, COUNT(*) fr FROM tab_wide JOIN supplier_meta USING (sample) GROUP BY ALL",
    "size": "SELECT region grp, sample, COUNT(*) rich, SUM(value) reads FROM tab_wide JOIN supplier_meta USING (sample) GROUP BY ALL",
    "ch0": f"SELECT it, sample, feature, rich, reads, ab, ROW_NUMBER() OVER (PARTITION BY it, sample ORDER BY -LN({u('5', 'it', 'sample', 'feature')}) / fr, feature) n FROM size JOIN pool USING (grp), i",
    "ch": "SELECT it, sample, feature, rich, reads, SUM(ab) OVER w - ab lo, SUM(ab) OVER w hi, SUM(ab) OVER (PARTITION BY it, sample) tot FROM ch0 WHERE n <= rich WINDOW w AS (PARTITION BY it, sample ORDER BY feature)",
    "rd": f"SELECT it, sample, FLOOR({u('5', 'it', 'sample', chr(39) + 'read' + chr(39), 'i')} * tot) a FROM (SELECT it, sample, tot, UNNEST(RANGE(1, CAST(reads - rich AS BIGINT) + 1)) i FROM (SELECT DISTINCT it, sample, rich, reads, tot FROM ch))",
    "rt": "SELECT it, sample, feature, SUM(n) value FROM (SELECT it, sample, feature, 1 n FROM ch UNION ALL SELECT it, sample, feature, 1 FROM rd JOIN ch USING (it, sample) WHERE a >= lo AND a < hi) GROUP BY ALL",
    "t": "SELECT 0::BIGINT it, sample, feature, value FROM tab_wide UNION ALL SELECT it, sample, feature, value FROM rt",
    "p": "SELECT it, feature, sample, value / SUM(value) OVER (PARTITION BY it, sample) p FROM t",
    "spine": "SELECT DISTINCT a.sample s1, b.sample s2 FROM size a JOIN size b ON a.sample < b.sample",
    "dn": "SELECT it, s1, s2, feature, SUM(CASE WHEN sample = s1 THEN p ELSE 0 END) x1, SUM(CASE WHEN sample = s2 THEN p ELSE 0 END) x2 FROM spine JOIN p ON p.sample IN (s1, s2) GROUP BY ALL",
}
for kind, value in {
    "bray": "1 - SUM(LEAST(x1, x2))", "jaccard": "1 - CAST(COUNT(*) FILTER (x1 > 0 AND x2 > 0) AS DOUBLE) / COUNT(*)", "naive": "LN(EXP(-SUM((x1 + x2) / 2 * LN((x1 + x2) / 2)) + SUM(CASE WHEN x1 > 0 THEN x1 * LN(x1) ELSE 0 END + CASE WHEN x2 > 0 THEN x2 * LN(x2) ELSE 0 END) / 2)) / LN(2)",
}.items():
    register(
        f"rcq_{kind}",
        lambda s, d, kind=kind: nulls.rcq(fx.tab_wide(s, d), kind, 1, RCQ_N, fx.regions(fx.supplier_meta(s, d)), seed=5),
        sql("tab_wide, supplier_meta", summary("s1, s2", "x", RCQ_N), **RCQ, x=f"SELECT it, s1, s2, {value} x FROM dn GROUP BY it, s1, s2"),
    )

    # Draws of many iterations are numpy's; what is observed is SQL.
    register(f"rcq_{kind}_999", lambda s, d, kind=kind: nulls.rcq(fx.tab_wide(s, d), kind, 1, 999, fx.regions(fx.supplier_meta(s, d)), seed=5, arrays=True))
    register(
        f"rcq_{kind}_observed",
        lambda s, d, kind=kind: nulls.rcq(fx.tab_wide(s, d), kind, 1, RCQ_N, fx.regions(fx.supplier_meta(s, d)), seed=5, arrays=True).select("s1", "s2", "obs"),
        sql("tab_wide, supplier_meta", f"SELECT s1, s2, {r(value, 'obs')} FROM dn WHERE it = 0 GROUP BY s1, s2", **RCQ | {"t": "SELECT 0::BIGINT it, sample, feature, value FROM tab_wide"}),
    )


# -- statistics

GW = "SELECT a.sample s1, b.sample s2, a.region r1, b.region r2, a.n_suppliers n1, b.n_suppliers n2, a.mean_acctbal m1, b.mean_acctbal m2 FROM nation_meta a JOIN nation_meta b ON a.sample < b.sample"
GV = "(CASE WHEN r1 = r2 THEN 0 ELSE 1 END + CASE WHEN ns > 0 THEN ABS(n1 - n2) / ns ELSE 0 END + CASE WHEN ms > 0 THEN ABS(m1 - m2) / ms ELSE 0 END) / 3"
GR = "SELECT CAST(MAX(n_suppliers) - MIN(n_suppliers) AS DOUBLE) ns, MAX(mean_acctbal) - MIN(mean_acctbal) ms FROM nation_meta"
register("gower", lambda s, d: st.gower(fx.nation_meta(s, d)), sql("nation_meta", f"SELECT s1, s2, {r(GV, 'value')} FROM g, gr", g=GW, gr=GR))
register("gower_similarity", lambda s, d: st.gower(fx.nation_meta(s, d), similarity=True), sql("nation_meta", f"SELECT s1, s2, {r('1 - ' + GV, 'value')} FROM g, gr", g=GW, gr=GR))

BRAY = "SELECT s1, s2, 1 - SUM(LEAST(x1, x2)) v FROM dn GROUP BY s1, s2"
_bray = {"p": P.format(tab="tab_small"), "spine": SPINE, "dn": DENSE, "br": BRAY}
MM = "SELECT x.s1, x.s2, x.v x, g.v y FROM br x JOIN gv g USING (s1, s2)"
PERM = f"SELECT a.it, a.sample, b.sample t FROM (SELECT it, sample, ROW_NUMBER() OVER (PARTITION BY it ORDER BY sample) k FROM sm, i) a JOIN (SELECT it, sample, ROW_NUMBER() OVER (PARTITION BY it ORDER BY {md5('5', 'it', 'sample')}, sample) k FROM sm, i) b USING (it, k)"


def mantel_sql(method: str, n: int) -> str:
    stat = "AVG(ABS(x - y))" if method == "absDist" else "1 - CORR(x, y)"
    mm = MM if method != "spearman" else "SELECT s1, s2, RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 x, RANK() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 y FROM m0"
    return sql(
        "tab_small, nation_meta", f"SELECT {r('stat', 'stat')}, {r(f'(SUM(CASE WHEN ROUND(nl, 10) <= ROUND(stat, 10) THEN 1 ELSE 0 END) + 1) / {n + 1}.0::DOUBLE', 'p')} FROM nu, (SELECT {stat} stat FROM mm) GROUP BY stat",
        **_bray, g=GW, gr=GR, gv=f"SELECT s1, s2, {GV} v FROM g, gr", m0=MM, mm=mm, sm="SELECT DISTINCT sample FROM p", i=f"SELECT UNNEST(RANGE(1, {n + 1})) it", pm=PERM,
        nu=f"SELECT it, {stat} nl FROM (SELECT a.it, LEAST(a.t, b.t) s1, GREATEST(a.t, b.t) s2, x FROM mm JOIN pm a ON a.sample = s1 JOIN pm b ON b.sample = s2 AND a.it = b.it) JOIN (SELECT s1, s2, y FROM mm) USING (s1, s2) GROUP BY it",
    )


for method in ("pearson", "spearman", "absDist"):
    register(f"mantel_{method.lower()}", lambda s, d, method=method: st.mantel(beta.bray(fx.tab_small(s, d)), st.gower(fx.nation_meta(s, d)), method, 19, 5), mantel_sql(method, 19))

register(
    "permanova_oneway",
    lambda s, d: st.permanova_oneway(beta.bray(fx.tab_small(s, d)), fx.regions(fx.nation_meta(s, d)), 19, 5),
    sql(
        "tab_small, nation_meta",
        f"SELECT 'group' AS term, CAST(k - 1 AS DOUBLE) df, {r('sst - ssw', 'ss')}, {r('(sst - ssw) / (k - 1)', 'ms')}, {r('f', 'f')}, {r('(sst - ssw) / sst', 'r2')}, {r('((SELECT COUNT(*) FROM fs x WHERE x.it > 0 AND ROUND(x.f, 10) >= ROUND(fs.f, 10)) + 1) / 20.0::DOUBLE', 'p')} FROM fs WHERE it = 0 UNION ALL SELECT 'Residual', CAST(n - k AS DOUBLE), {r('ssw', 'ss')}, {r('ssw / (n - k)', 'ms')}, NULL, {r('ssw / sst', 'r2')}, NULL FROM fs WHERE it = 0",
        **_bray, sm="SELECT DISTINCT sample FROM nation_meta", i="SELECT UNNEST(RANGE(1, 20)) it", pm=PERM, nm="SELECT it, pm.sample, region grp FROM pm JOIN nation_meta m ON m.sample = pm.t UNION ALL SELECT 0, sample, region FROM nation_meta",
        sz="SELECT it, grp, COUNT(*) n FROM nm GROUP BY ALL", wi="SELECT a.it, a.grp, SUM(v * v) d2 FROM br JOIN nm a ON a.sample = s1 JOIN nm b ON b.sample = s2 AND a.it = b.it AND a.grp = b.grp GROUP BY ALL",
        fs="SELECT it, n, k, sst, ssw, ((sst - ssw) / (k - 1)) / (ssw / (n - k)) f FROM (SELECT it, SUM(n) n, COUNT(*) k, SUM(COALESCE(d2 / n, 0)) ssw, (SELECT SUM(v * v) FROM br) / SUM(n) sst FROM sz LEFT JOIN wi USING (it, grp) GROUP BY it)",
    ),
)
register(
    "double_center",
    lambda s, d: ordination.double_center(beta.bray(fx.tab_small(s, d))),
    sql(
        "tab_small", f"SELECT s1, s2, {r('a - AVG(a) OVER (PARTITION BY s1) - AVG(a) OVER (PARTITION BY s2) + AVG(a) OVER ()', 'a')} FROM fu", **_bray,
        fu="SELECT s1, s2, -v * v / 2 a FROM br UNION ALL SELECT s2, s1, -v * v / 2 FROM br UNION ALL SELECT sample, sample, 0 FROM (SELECT DISTINCT sample FROM p)",
    ),
)


def _corr_meta(s, d):
    m = fx.supplier_meta(s, d)
    size = fx.tab_wide(s, d).groupBy("sample").agg(F.sum("value").alias("reads"), F.count(F.lit(1)).cast("double").alias("richness"))
    m = m.join(size, "sample")
    return m.withColumn("rich", F.when(F.col("richness") > 515, "yes").otherwise("no")).withColumn("acctbal", F.when(F.col("sample").cast("int") % 10 != 0, F.col("acctbal")))


_cm = "SELECT m.*, reads, richness, CASE WHEN richness > 515 THEN 'yes' ELSE 'no' END rich FROM (SELECT sample, region, CASE WHEN CAST(sample AS INT) % 10 <> 0 THEN acctbal END acctbal FROM supplier_meta) m JOIN (SELECT sample, SUM(value) reads, CAST(COUNT(*) AS DOUBLE) richness FROM tab_wide GROUP BY 1) USING (sample)"
_num = "SELECT sample, col, x FROM (SELECT sample, 'acctbal' col, acctbal x FROM cm UNION ALL SELECT sample, 'reads', reads FROM cm UNION ALL SELECT sample, 'richness', richness FROM cm) WHERE x IS NOT NULL"
_cat = "SELECT sample, 'region' col, region c FROM cm UNION ALL SELECT sample, 'rich', rich FROM cm"
CORR = {
    "cm": _cm, "nu": _num, "ca": _cat,
    "nn": "SELECT a.col a, b.col b, a.x, b.x y FROM nu a JOIN nu b ON a.sample = b.sample AND a.col < b.col",
    "nr": "SELECT a, b, RANK() OVER (PARTITION BY a, b ORDER BY x) + (COUNT(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 x, RANK() OVER (PARTITION BY a, b ORDER BY y) + (COUNT(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 y FROM nn",
    "cn": "SELECT a.col a, b.col b, c, x y FROM ca a JOIN nu b USING (sample)",
    "cw": "SELECT a, b, COUNT(*) n, AVG(y) m, STDDEV_SAMP(y) sd, VAR_POP(y) vp, MIN(c) lo FROM cn GROUP BY ALL",
    "cc": "SELECT a, b, c, COUNT(*) mm, AVG(y) mc FROM cn GROUP BY ALL",
    "cs": "SELECT a, b, n, CASE WHEN n < 3 OR COUNT(*) < 2 OR COUNT(*) = 2 AND MIN(mm) < 2 THEN NULL WHEN COUNT(*) = 2 THEN (MAX(CASE WHEN c = lo THEN mc END) - MAX(CASE WHEN c <> lo THEN mc END)) / sd * SQRT(MAX(CASE WHEN c = lo THEN mm END) * (n - MAX(CASE WHEN c = lo THEN mm END)) / CAST(n * n AS DOUBLE)) ELSE SQRT(SUM(mm * POW(mc - m, 2)) / (vp * n)) END r, CASE WHEN COUNT(*) = 2 THEN 'point-biserial' ELSE 'eta' END kind FROM cc JOIN cw USING (a, b) GROUP BY a, b, n, sd, vp",
    "xy": "SELECT a.col a, b.col b, a.c x, b.c y FROM ca a JOIN ca b ON a.sample = b.sample AND a.col < b.col",
    "ch": "SELECT a, b, SUM(CAST(o * o AS DOUBLE) / (nx * ny)) - 1 ph, n, rr, kk FROM (SELECT a, b, x, y, COUNT(*) o FROM xy GROUP BY ALL) JOIN (SELECT a, b, x, COUNT(*) nx FROM xy GROUP BY ALL) USING (a, b, x) JOIN (SELECT a, b, y, COUNT(*) ny FROM xy GROUP BY ALL) USING (a, b, y) JOIN (SELECT a, b, COUNT(*) n, COUNT(DISTINCT x) rr, COUNT(DISTINCT y) kk FROM xy GROUP BY ALL) USING (a, b) GROUP BY a, b, n, rr, kk",
}
V = "CASE WHEN rr >= 2 AND kk >= 2 THEN SQRT(GREATEST(0, ph - (kk - 1) * (rr - 1) / (n - 1.0::DOUBLE)) / LEAST(kk - POW(kk - 1, 2) / (n - 1) - 1, rr - POW(rr - 1, 2) / (n - 1) - 1)) END"
for method, source in (("spearman", "nr"), ("pearson", "nn")):
    register(
        f"corr_mixed_{method}",
        lambda s, d, method=method: st.correlations(_corr_meta(s, d), ["acctbal", "reads", "richness"], ["region", "rich"], method),
        sql("supplier_meta, tab_wide", f"SELECT a, b, '{method}' AS kind, COUNT(*) n, {r('CORR(x, y)', 'r')} FROM {source} GROUP BY a, b UNION ALL SELECT a, b, kind, n, {r('r', 'r')} FROM cs UNION ALL SELECT a, b, 'cramers-v', n, {r(V, 'r')} FROM ch", **CORR),
    )

register("corr_inferred", lambda s, d: st.correlate(_corr_meta(s, d).select("sample", "acctbal", "reads", "richness", "region", "rich")), sql("supplier_meta, tab_wide", f"SELECT a, b, 'spearman' AS kind, COUNT(*) n, {r('CORR(x, y)', 'r')} FROM nr GROUP BY a, b UNION ALL SELECT a, b, kind, n, {r('r', 'r')} FROM cs UNION ALL SELECT a, b, 'cramers-v', n, {r(V, 'r')} FROM ch", **CORR))
register("corr_coding", lambda s, d: st.coding(_corr_meta(s, d), ["reads", "richness"], ["region", "rich"]), sql("supplier_meta, tab_wide", "SELECT a, b, CASE WHEN n = 2 THEN 'point-biserial' ELSE 'eta' END kind, CASE WHEN n = 2 THEN lo END positive FROM (SELECT col a, COUNT(DISTINCT c) n, MIN(c) lo FROM ca GROUP BY 1), (SELECT UNNEST(['reads', 'richness']) b)", **CORR))


def _ps(s, d):
    nat = fx.read(s, d, "nation")
    return nat.select(F.col("n_name").alias("a"), F.col("n_regionkey").cast("string").alias("b"), ((F.col("n_nationkey") * 7 % 25 + 1) / F.lit(100.0)).alias("p"))


register(
    "fdr_bh",
    lambda s, d: st.benjamini_hochberg(_ps(s, d)),
    f"SELECT a, b, {r('p', 'p')}, {r('LEAST(1, MIN(p * 25 / rk) OVER (ORDER BY rk DESC))', 'padj')} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p, a, b) rk FROM (SELECT n_name a, CAST(n_regionkey AS VARCHAR) b, (n_nationkey * 7 % 25 + 1) / 100.0::DOUBLE p FROM nation))",
)
register("corr_permuted", lambda s, d: st.correlations(_corr_meta(s, d), ["acctbal", "reads", "richness"], ["region", "rich"], n=19, seed=5))

register(
    "bootstrap_matrix",
    lambda s, d: st.bootstrap(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d).withColumn("big", (F.col("n_suppliers") > 3).cast("string")), ["region", "big"], 12, seed=5),
    sql(
        "tab_small, nation_meta", f"SELECT factor, part, {r('AVG(m)', 'mean')}, {r('quantile_cont(m, 0.025)', 'lo')}, {r('quantile_cont(m, 0.975)', 'hi')}, CAST(FLOOR(SUM(n) / 12.0) AS BIGINT) pairs FROM ea GROUP BY factor, part",
        **_bray, ce="SELECT *, ROW_NUMBER() OVER (PARTITION BY cr ORDER BY sample) - 1 k, COUNT(*) OVER (PARTITION BY cr) m FROM (SELECT sample, region, CASE WHEN n_suppliers > 3 THEN 'true' ELSE 'false' END big, region || '|' || CASE WHEN n_suppliers > 3 THEN 'true' ELSE 'false' END cr FROM nation_meta)",
        dr=f"SELECT DISTINCT boot, cr, CAST(FLOOR({u('5', 'boot', 'cr', 'k')} * m) AS BIGINT) k FROM ce, (SELECT UNNEST(RANGE(1, 13)) boot)", dd="SELECT boot, sample, region, big, cr FROM dr JOIN ce USING (cr, k)",
        pr="SELECT a.boot, v, a.region r1, b.region r2, a.big b1, b.big b2, a.cr c1, b.cr c2 FROM br JOIN dd a ON a.sample = s1 JOIN dd b ON b.sample = s2 AND a.boot = b.boot",
        ea="SELECT boot, factor, part, AVG(v) m, COUNT(*) n FROM (SELECT boot, v, 'region' factor, CASE WHEN r1 = r2 THEN 'within' ELSE 'between' END part FROM pr UNION ALL SELECT boot, v, 'big', CASE WHEN b1 = b2 THEN 'within' ELSE 'between' END FROM pr UNION ALL SELECT boot, v, 'Crossed', CASE WHEN c1 = c2 THEN 'within' ELSE 'between' END FROM pr) GROUP BY ALL",
    ),
)

# -- ordination: dense algebra, rows only

register("pcoa", lambda s, d: ordination.pcoa(beta.bray(fx.tab_small(s, d))))
register("pcoa_lingoes", lambda s, d: ordination.pcoa(beta.bray(fx.tab_small(s, d)), "lingoes"))
register("permanova_twoway", lambda s, d: ordination.permanova(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), ["region", "mean_acctbal"], 99, 5))
register("permanova_freedman_lane", lambda s, d: ordination.permanova(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), ["region", "n_suppliers"], 99, 5, scheme="freedman-lane"))
for part in ("sites", "biplot", "axes", "terms", "test"):
    register(f"dbrda_{part}", lambda s, d, part=part: ordination.dbrda(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), ["region", "mean_acctbal"], n=99)[part])
register("dbrda_marginal", lambda s, d: ordination.dbrda_marginal(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), ["region", "mean_acctbal"], n=99))
register("dbrda_summary", lambda s, d: ordination.dbrda_summary(beta.bray(fx.tab_small(s, d)), fx.nation_meta(s, d), ["region", "mean_acctbal"], n=99))
register("ordination_ellipse", lambda s, d: ordination.ellipse(ordination.pcoa(beta.bray(fx.tab_small(s, d))), fx.regions(fx.nation_meta(s, d))))
register("ordination_biplot", lambda s, d: ordination.biplot(ordination.pcoa(beta.bray(fx.tab_small(s, d))).where("axis <= 2"), fx.nation_meta(s, d).select("sample", F.lit("mean_acctbal").alias("variable"), F.col("mean_acctbal").alias("value"))))

# -- several data sets


def _objects(s, d, held=False):
    """``held``: tables are computed once, for what reads them several times."""
    li, tasks = fx.read(s, d, "lineitem"), fx.tasks(s, d)
    out = []
    for cond in ("l_returnflag = 'R'", "l_returnflag <> 'R'"):
        rows = li.where(cond).select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").cast("double").alias("value"))
        tab = dealt(rows, tasks, "feature").groupBy("feature", "sample").agg(F.sum("value").alias("value"))
        tab = settled(tab) if held else tab
        ids = tab.select("feature").distinct()
        out.append({"tab": tab, "seq": fx.seq(s, d).join(ids, "feature", "left_semi"), "tax": fx.tax(s, d).select("feature", "Domain").join(ids, "feature", "left_semi"), "meta": fx.supplier_meta(s, d)})
    return out


OBJ = {
    "tb": "SELECT CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END obj, CAST(l_partkey AS VARCHAR) feature, CAST(l_suppkey AS VARCHAR) sample, SUM(CAST(l_quantity AS DOUBLE)) value FROM lineitem GROUP BY ALL",
    "sq": "SELECT DISTINCT obj, feature, p_name seq FROM tb JOIN part ON CAST(p_partkey AS VARCHAR) = feature",
    "od": "SELECT *, ROW_NUMBER() OVER (PARTITION BY obj ORDER BY CAST(feature AS INT)) o FROM sq",
    "nm": "SELECT seq, 'SV' || ROW_NUMBER() OVER (ORDER BY a, seq) nw FROM (SELECT seq, MIN(obj * 1000000 + o) a FROM od GROUP BY seq)",
    "al": "SELECT obj, nw feature, sample, SUM(value) value FROM tb JOIN sq USING (obj, feature) JOIN nm USING (seq) GROUP BY ALL",
}
register("align_exact", lambda s, d: combine.align(_objects(s, d))[1]["tab"], sql("", "SELECT feature, sample, value FROM al WHERE obj = 1", **OBJ))
register("align_sequences", lambda s, d: combine.align(_objects(s, d))[0]["seq"], sql("", "SELECT DISTINCT nw feature, seq FROM sq JOIN nm USING (seq) WHERE obj = 0", **OBJ))
register(
    "consensus",
    lambda s, d: combine.consensus(_objects(s, d, held=True), keep_object=1, keep_cutoff=3.0)[0]["tab"],
    sql(
        "", "SELECT nw2 feature, sample, value FROM al JOIN rn ON rn.feature = al.feature WHERE obj = 1", **OBJ, co="SELECT feature FROM al GROUP BY feature HAVING COUNT(DISTINCT obj) = 2 UNION SELECT feature FROM (SELECT feature, 100 * value / SUM(value) OVER (PARTITION BY sample) ra FROM al WHERE obj = 1) WHERE ra > 3.0",
        rn="SELECT feature, 'SV' || ROW_NUMBER() OVER (ORDER BY SUM(value) DESC, CAST(SUBSTR(feature, 3) AS INT)) nw2 FROM al WHERE obj = 1 AND feature IN (SELECT feature FROM co) GROUP BY feature",
    ),
)
register("consensus_info", lambda s, d: combine.consensus_info(_objects(s, d, held=True)), sql("", f"SELECT CAST(obj AS INT) obj, (SELECT COUNT(*) FROM co) n_common, {r('100 * SUM(CASE WHEN feature IN (SELECT feature FROM co) THEN value ELSE 0 END) / SUM(value)', 'pct_reads')}, obj = (SELECT arg_max(obj, sh) FROM (SELECT obj, SUM(CASE WHEN feature IN (SELECT feature FROM co) THEN value ELSE 0 END) / SUM(value) sh FROM al GROUP BY obj)) kept FROM al GROUP BY obj", **OBJ, co="SELECT feature FROM al GROUP BY feature HAVING COUNT(DISTINCT obj) = 2"))
register("merge_objects", lambda s, d: combine.merge_objects(_objects(s, d))["tab"], sql("", "SELECT nw2 feature, sample || '_' || obj sample, value FROM al JOIN rn USING (feature)", **OBJ, rn="SELECT feature, 'SV' || ROW_NUMBER() OVER (ORDER BY SUM(value) DESC, CAST(SUBSTR(feature, 3) AS INT)) nw2 FROM al GROUP BY feature"))
register("merge_objects_meta", lambda s, d: combine.merge_objects(_objects(s, d))["meta"], sql("supplier_meta", f"SELECT sample || '_' || o AS sample, region, nation, {r('acctbal', 'acctbal')} FROM supplier_meta, (SELECT UNNEST([0, 1]) o)"))


def _trimmed(s, d):
    """The second object's sequences lose ends, so that the first's hold them;
    some of the first's lose more."""
    one, two = _objects(s, d)
    k = F.col("feature").cast("int")
    full = fx.seq_long(s, d)
    one["seq"] = full.join(one["seq"].select("feature"), "feature", "left_semi").withColumn("seq", F.when(k % 5 == 0, F.expr("substring(seq, 4, length(seq) - 5)")).otherwise(F.col("seq")))
    two["seq"] = full.join(two["seq"].select("feature"), "feature", "left_semi").withColumn("seq", F.when(k % 3 == 0, F.expr("substring(seq, 3, length(seq) - 4)")).otherwise(F.col("seq")))
    return [one, two]


_TRIM = {
    "tb": OBJ["tb"],
    "sq": "SELECT DISTINCT obj, feature, CASE WHEN obj = 0 AND CAST(feature AS INT) % 5 = 0 THEN SUBSTR(seq, 4, LENGTH(seq) - 5) WHEN obj = 1 AND CAST(feature AS INT) % 3 = 0 THEN SUBSTR(seq, 3, LENGTH(seq) - 4) ELSE seq END seq FROM tb JOIN seq_long USING (feature)",
    "od": OBJ["od"],
    "fs": "SELECT seq, MIN(obj * 1000000 + o) a FROM od GROUP BY seq",
    "hd": "SELECT n.seq, MIN(k.a) root FROM fs n JOIN fs k ON n.a >= 1000000 AND k.a < 1000000 AND (contains(n.seq, k.seq) OR contains(k.seq, n.seq)) GROUP BY n.seq",
    "rt": "SELECT fs.seq, a, COALESCE(root, a) root FROM fs LEFT JOIN hd USING (seq)",
    "nr": "SELECT root, 'SV' || ROW_NUMBER() OVER (ORDER BY root) nw FROM (SELECT DISTINCT root FROM rt)",
    "cn": "SELECT nw, arg_max(seq, LENGTH(seq) * 100000000::BIGINT - a) canonical FROM rt JOIN nr USING (root) GROUP BY nw",
}
register("align_substring", lambda s, d: combine.align(_trimmed(s, d), different_lengths=True)[1]["seq"], sql("seq_long", "SELECT DISTINCT nw feature, canonical seq FROM sq JOIN rt USING (seq) JOIN nr USING (root) JOIN cn USING (nw) WHERE obj = 1", **_TRIM))
register("align_substring_tab", lambda s, d: combine.align(_trimmed(s, d), different_lengths=True)[1]["tab"], sql("seq_long", "SELECT nw feature, sample, SUM(value) value FROM tb JOIN sq USING (obj, feature) JOIN rt USING (seq) JOIN nr USING (root) WHERE obj = 1 GROUP BY ALL", **_TRIM))
register("seq_containments", lambda s, d: sequences.containments(fx.seq(s, d).groupBy("seq").agg(F.min(F.col("feature").cast("long")).alias("id"))), sql("", "SELECT b.id AS \"inner\", a.id AS \"outer\" FROM q a JOIN q b ON a.id <> b.id AND contains(a.seq, b.seq)", q="SELECT p_name seq, MIN(p_partkey) id FROM part GROUP BY 1"))
for k in (0, 1, 3):
    register(f"seq_similar_{k}", lambda s, d, k=k: sequences.similar(fx.seq_long(s, d), k), sql("seq_long", f"SELECT a.feature f1, b.feature f2, CAST(levenshtein(a.seq, b.seq) AS INT) distance, {r('levenshtein(a.seq, b.seq) / CAST(GREATEST(LENGTH(a.seq), LENGTH(b.seq)) AS DOUBLE)', 'normalized')} FROM seq_long a JOIN seq_long b ON a.feature < b.feature AND ABS(LENGTH(a.seq) - LENGTH(b.seq)) <= {k} WHERE levenshtein(a.seq, b.seq) <= {k}"))
# Within the band the edits are exact; beyond it they need not be.
register("seq_distance_band_4", lambda s, d: combine.sequence_distance(fx.seq(s, d), band=4).where("distance <= 4"), sql("seq", f"SELECT a.feature f1, b.feature f2, CAST(levenshtein(a.seq, b.seq) AS INT) distance, {r('levenshtein(a.seq, b.seq) / CAST(GREATEST(LENGTH(a.seq), LENGTH(b.seq)) AS DOUBLE)', 'normalized')} FROM seq a JOIN seq b ON a.feature < b.feature WHERE levenshtein(a.seq, b.seq) <= 4"))
register("seq_distance", lambda s, d: combine.sequence_distance(fx.seq(s, d)), sql("seq", f"SELECT a.feature f1, b.feature f2, CAST(levenshtein(a.seq, b.seq) AS INT) distance, {r('levenshtein(a.seq, b.seq) / CAST(GREATEST(LENGTH(a.seq), LENGTH(b.seq)) AS DOUBLE)', 'normalized')} FROM seq a JOIN seq b ON a.feature < b.feature"))
register("seq_distance_banded", lambda s, d: combine.sequence_distance(fx.seq(s, d), band=100), sql("seq", f"SELECT a.feature f1, b.feature f2, CAST(levenshtein(a.seq, b.seq) AS INT) distance, {r('levenshtein(a.seq, b.seq) / CAST(GREATEST(LENGTH(a.seq), LENGTH(b.seq)) AS DOUBLE)', 'normalized')} FROM seq a JOIN seq b ON a.feature < b.feature"))

# -- simulators

_NORMAL = f"SQRT(-2.0::DOUBLE * LN({u('5', 'sample', 'feature', chr(39) + 'r' + chr(39))})) * COS(6.283185307179586::DOUBLE * {u('5', 'sample', 'feature', chr(39) + 'a' + chr(39))})"
register("simulate_community", lambda s, d: simulate.simulate_community(s, 60, 4, 1.5, 0.5, 5), f"SELECT feature, sample, {r('100 * x / SUM(x) OVER (PARTITION BY sample)', 'value')} FROM (SELECT feature, sample, EXP(0.5::DOUBLE + 1.5::DOUBLE * {_NORMAL}) x FROM (SELECT 'SP' || UNNEST(RANGE(1, 61)) feature), (SELECT 'C' || UNNEST(RANGE(1, 5)) sample))")
register("interdependence", lambda s, d: simulate.interdependence_matrix(s, 20, 0.3, 0.4, True, -0.1, 5), f"SELECT i, j, {r(f'CASE WHEN i = j THEN -0.1 ELSE {u(chr(39) + "5" + chr(39), chr(39) + "m" + chr(39), "LEAST(i, j)", "GREATEST(i, j)")} * 0.3::DOUBLE * CASE WHEN {u(chr(39) + "5" + chr(39), chr(39) + "s" + chr(39), "LEAST(i, j)", "GREATEST(i, j)")} < 0.4 THEN 1 ELSE -1 END END', 'value')} FROM (SELECT UNNEST(RANGE(1, 21)) i), (SELECT UNNEST(RANGE(1, 21)) j)")


def _assembly(s, d):
    tab = fx.tab_small(s, d)
    return tab.withColumn("immigrants", F.col("value") % 7 + 1).withColumn("fitness", F.col("value") % 5 + 1)


register("assembly_k_steps", lambda s, d: simulate.assembly_steps(_assembly(s, d), 3, 2.0, 1.0), sql("tab_small", f"SELECT feature, sample, {r('100 * x / SUM(x) OVER (PARTITION BY sample)', 'value')} FROM (SELECT feature, sample, value * POW((value % 5 + 1) * 2.0 / 3 + (value % 7 + 1) / 3.0, 3) x FROM tab_small)"))
register("simulate_assembly", lambda s, d: simulate.simulate_assembly(_assembly(s, d), selection=2.0, dispersal=1.0, max_iter=50)[0])
register("block_tree", lambda s, d: simulate.block_tree(s, [2, 3, 4], [0.5, 0.3, 0.2])[0].groupBy("branchL").agg(F.count(F.lit(1)).alias("n"), F.max("dist_to_root").alias("height")), f"SELECT * FROM (VALUES (0.0::DOUBLE, 1::BIGINT, 0.0::DOUBLE), (0.5, 2, 0.5), (0.3, 6, 0.8), (0.2, 24, 1.0)) t(\"branchL\", n, height)")
register("beta_split_tree", lambda s, d: simulate.beta_splitting_tree(s, 40, -1.0, seed=5)[0])
register(
    "null_custom",
    lambda s, d: nulls.null_from(lambda w: w.groupBy("it", "sample").agg(F.max("w").alias("value")), alpha.powers(fx.tab_small(s, d), 1), ["sample"], 3),
    sql("tab_small", f"SELECT sample, {r('MAX(p)', 'obs')}, {r('MAX(p)', 'null_mean')}, 0.0::DOUBLE null_std, 0.5::DOUBLE p, NULL::DOUBLE ses FROM p GROUP BY sample", p=P.format(tab="tab_small")),
)
