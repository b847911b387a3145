"""Alpha, beta and tree queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alpha, beta, trees
from . import fixtures as fx
from .registry import r, register, sql

P = "SELECT feature, sample, value / SUM(value) OVER (PARTITION BY sample) p FROM {tab} WHERE value > 0"


def term(x: str, q: float) -> str:
    return f"({x}) * LN({x})" if q == 1 else f"POW({x}, {q})"


def from_sum(x: str, q: float, root: float = 1.0) -> str:
    return f"EXP(-({x}) / {root:.1f})" if q == 1 else f"POW({x}, {1 / (root * (1 - q))!r})"


def dis(b: str, q: float, n: str, div: str = "naive", view: str = "regional") -> str:
    k = 2 if div == "func" else 1
    if q == 1:
        out = f"LN({b}) / NULLIF(LN({n}) * {k}, 0)"
    elif view == "local":
        out = f"1 - (POW({n}, {k * (1 - q)!r}) - POW({b}, {1 - q!r})) / NULLIF(POW({n}, {k * (1 - q)!r}) - 1, 0)"
    else:
        out = f"1 - (POW({b}, {-(1 - q)!r}) - POW({n}, {-k * (1 - q)!r})) / NULLIF(1 - POW({n}, {-k * (1 - q)!r}), 0)"
    return f"CASE WHEN ({b}) <= 0 THEN {b} ELSE {out} END"


def qname(q: float) -> str:
    return f"q{q:g}".replace(".", "")


# -- alpha

for q in (0, 1, 2, 1.5):
    register(f"naive_alpha_{qname(q)}", lambda s, d, q=q: alpha.naive_alpha(fx.tab_wide(s, d), q), sql("tab_wide", f"SELECT sample, {r(from_sum(f'SUM({term('p', q)})', q), 'd')} FROM p GROUP BY sample", p=P.format(tab="tab_wide")))

register("rel_abundance", lambda s, d: alpha.relative(fx.tab_wide(s, d)), sql("tab_wide", f"SELECT feature, sample, {r('p', 'p')} FROM p", p=P.format(tab="tab_wide")))

register(
    "alpha_profile",
    lambda s, d: alpha.alpha_profile(fx.tab_small(s, d)),
    sql("tab_small", f"SELECT CAST(q AS DOUBLE) / 20 q, sample, {r('CASE WHEN q = 20 THEN EXP(-SUM(p * LN(p))) ELSE POW(SUM(POW(p, q / 20.0)), 1 / NULLIF(1 - q / 20.0, 0)) END', 'd')} FROM p, (SELECT UNNEST(RANGE(0, 41)) q) g GROUP BY q, sample", p=P.format(tab="tab_small")),
)

A = "SELECT node, sample, branchL, SUM(p) a FROM p JOIN {leaves} l ON l.leaf = p.feature JOIN {tree} t USING (node) GROUP BY node, sample, branchL"

for index, q, size in [("D", 0, "large"), ("D", 1, "large"), ("D", 2, "large"), ("PD", 1, "small"), ("H", 1, "small"), ("H", 2, "small"), ("D", 1.5, "small")]:
    tab = "tab_wide" if size == "large" else "tab_small"
    h = f"(SUM(branchL * {term('a', q)}) / SUM(branchL * a))"
    d_sql = {"D": from_sum(h, q), "PD": f"{from_sum(h, q)} * SUM(branchL * a)", "H": h}[index]
    register(
        f"phyl_alpha_{index}_{qname(q)}",
        lambda s, d, index=index, q=q, size=size, tab=tab: alpha.phyl_alpha(getattr(fx, tab)(s, d), getattr(fx, f"tree_{size}")(s, d), getattr(fx, f"leaves_{size}")(s, d), q, index, tasks=fx.tasks(s, d)),
        sql(f"{tab}, tree_{size}, leaves_{size}", f"SELECT sample, {r(d_sql, 'd')} FROM a GROUP BY sample", p=P.format(tab=tab), a=A.format(leaves=f"leaves_{size}", tree=f"tree_{size}")),
    )

register("branch_abundance", lambda s, d: alpha.branch_shares(fx.tab_small(s, d), fx.leaves_small(s, d)), sql("tab_small, tree_small, leaves_small", f"SELECT node, sample, {r('a', 'a')} FROM a", p=P.format(tab="tab_small"), a=A.format(leaves="leaves_small", tree="tree_small")))
register("tmean", lambda s, d: alpha.mean_height(fx.tab_wide(s, d), fx.tree_large(s, d), fx.leaves_large(s, d), tasks=fx.tasks(s, d)), sql("tab_wide, tree_large, leaves_large", f"SELECT sample, {r('SUM(branchL * a)', 't')} FROM a GROUP BY sample", p=P.format(tab="tab_wide"), a=A.format(leaves="leaves_large", tree="tree_large")))

PAIRS = "SELECT a.sample, a.feature f1, b.feature f2, a.p p1, b.p p2, d FROM p a JOIN p b USING (sample) JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature"

register("rao_q", lambda s, d: alpha.rao(fx.tab_small(s, d), fx.distmat(s, d)), sql("tab_small, distmat", f"SELECT sample, {r('SUM(d * p1 * p2)', 'q_rao')} FROM x GROUP BY sample", p=P.format(tab="tab_small"), x=PAIRS))

for index, q in [("FD", 1), ("D", 1), ("MD", 1), ("D", 0), ("FD", 2), ("D", 2)]:
    qr = "SUM(d * p1 * p2)"
    s_ = f"SUM(d * {term('p1 * p2', q)}) / {qr}"
    d_sql = {"D": from_sum(s_, q, 2.0), "MD": f"{from_sum(s_, q, 2.0)} * {qr}", "FD": f"POW({from_sum(s_, q, 2.0)}, 2) * {qr}"}[index]
    register(f"func_alpha_{index}_{qname(q)}", lambda s, d, index=index, q=q: alpha.func_alpha(fx.tab_small(s, d), fx.distmat(s, d), q, index), sql("tab_small, distmat", f"SELECT sample, {r(d_sql, 'd')} FROM x GROUP BY sample", p=P.format(tab="tab_small"), x=PAIRS))

register(
    "phyl_profile",
    lambda s, d: alpha.phyl_profile(fx.tab_small(s, d), fx.tree_small(s, d), fx.leaves_small(s, d)),
    sql(
        "tab_small, tree_small, leaves_small", f"SELECT CAST(k AS DOUBLE) / 20 q, sample, {r('CASE WHEN k = 20 THEN EXP(-SUM(branchL * a * LN(a)) / SUM(branchL * a)) ELSE POW(SUM(branchL * POW(a, k / 20.0)) / SUM(branchL * a), 1 / NULLIF(1 - k / 20.0, 0)) END', 'd')} FROM a, grid GROUP BY k, sample",
        p=P.format(tab="tab_small"), a=A.format(leaves="leaves_small", tree="tree_small"), grid="SELECT UNNEST(RANGE(0, 41)) k",
    ),
)
register(
    "func_profile",
    lambda s, d: alpha.func_profile(fx.tab_small(s, d), fx.distmat(s, d)),
    sql(
        "tab_small, distmat", f"SELECT CAST(k AS DOUBLE) / 20 q, sample, {r('CASE WHEN k = 20 THEN EXP(-SUM(d * p1 * p2 * LN(p1 * p2)) / SUM(d * p1 * p2)) ELSE POW(SUM(d * POW(p1 * p2, k / 20.0)) / SUM(d * p1 * p2), 1 / NULLIF(1 - k / 20.0, 0)) END * SUM(d * p1 * p2)', 'd')} FROM x, grid GROUP BY k, sample",
        p=P.format(tab="tab_small"), x=PAIRS, grid="SELECT UNNEST(RANGE(0, 41)) k",
    ),
)

for q in (0, 1, 2):
    register(
        f"mpd_{qname(q)}",
        lambda s, d, q=q: alpha.mpd(fx.tab_small(s, d), fx.distmat(s, d), q),
        sql("tab_small, distmat", f"SELECT sample, {r(f'SUM(d * POW(p1, {q}) * POW(p2, {q})) / SUM(POW(p1, {q}) * POW(p2, {q}))', 'mpd')} FROM x GROUP BY sample", p=P.format(tab="tab_small"), x=PAIRS),
    )
    register(
        f"mntd_{qname(q)}",
        lambda s, d, q=q: alpha.mntd(fx.tab_small(s, d), fx.distmat(s, d), q),
        sql("tab_small, distmat", f"SELECT sample, {r(f'SUM(POW(p1, {q}) * near) / SUM(POW(p1, {q}))', 'mntd')} FROM (SELECT sample, f1, p1, MIN(d) near FROM x GROUP BY sample, f1, p1) GROUP BY sample", p=P.format(tab="tab_small"), x=PAIRS),
    )


def even(d: str, s: str, q: float, index: str) -> str:
    if index in ("CR1", "regional", "CR2", "local"):
        w = 1 - q if index in ("CR1", "regional") else q - 1
        return f"LN({d}) / NULLIF(LN({s}), 0)" if q == 1 else f"(1 - POW({d}, {w!r})) / NULLIF(1 - POW({s}, {w!r}), 0)"
    return {"CR3": f"({d} - 1) / NULLIF({s} - 1, 0)", "CR4": f"(1 - 1 / {d}) / NULLIF(1 - 1 / {s}, 0)"}.get(index, f"LN({d}) / NULLIF(LN({s}), 0)")


for index, q in [("CR1", 2), ("CR2", 2), ("CR3", 1), ("CR4", 1), ("CR5", 1), ("pielou", 1), ("regional", 0.5), ("local", 1)]:
    ds = f"SELECT sample, {from_sum(f'SUM({term('p', q)})', q)} d, CAST(COUNT(*) AS DOUBLE) s FROM p GROUP BY sample"
    register(f"evenness_{index.lower()}_{qname(q)}", lambda s, d, index=index, q=q: alpha.evenness(fx.tab_wide(s, d), q, index), sql("tab_wide", f"SELECT sample, {r(even('d', 's', q, index), 'evenness')} FROM ds", p=P.format(tab="tab_wide"), ds=ds))

PT = "SELECT feature, sample, value / SUM(value) OVER (PARTITION BY feature) p FROM {tab} WHERE value > 0"
register(
    "evenness_taxa",
    lambda s, d: alpha.evenness(fx.tab_wide(s, d), 2, "CR1", perspective="taxa"),
    sql("tab_wide", f"SELECT feature, {r(even('d', 's', 2, 'CR1'), 'evenness')} FROM (SELECT feature, POW(SUM(POW(p, 2)), -1) d FROM p GROUP BY feature) x, (SELECT CAST(COUNT(DISTINCT sample) AS DOUBLE) s FROM tab_wide) n", p=PT.format(tab="tab_wide")),
)
register(
    "evenness_func",
    lambda s, d: alpha.evenness(fx.tab_small(s, d), 1, "CR1", div_type="func", distmat=fx.distmat(s, d)),
    sql("tab_small, distmat", f"SELECT sample, {r('LN(d) / LN(s)', 'evenness')} FROM (SELECT sample, EXP(-SUM(d * p1 * p2 * LN(p1 * p2)) / SUM(d * p1 * p2) / 2) d FROM x GROUP BY sample) a JOIN (SELECT sample, CAST(COUNT(*) AS DOUBLE) s FROM p GROUP BY sample) b USING (sample)", p=P.format(tab="tab_small"), x=PAIRS),
)

# -- beta

SPINE = "SELECT a.sample s1, b.sample s2 FROM (SELECT DISTINCT sample FROM p) a JOIN (SELECT DISTINCT sample FROM p) b ON a.sample < b.sample"
#: Every pair with every feature of either, zeros where one lacks it.
DENSE = "SELECT s1, s2, feature, SUM(CASE WHEN sample = s1 THEN p ELSE 0 END) x1, SUM(CASE WHEN sample = s2 THEN p ELSE 0 END) x2 FROM spine JOIN p ON p.sample IN (s1, s2) GROUP BY s1, s2, feature"


def pos(x: str, q: float) -> str:
    return f"CASE WHEN ({x}) > 0 THEN {term(x, q)} ELSE 0 END"


for q, view in [(0, "regional"), (1, "regional"), (2, "regional"), (0, "local"), (1, "local"), (2, "local"), (1.5, "regional"), (1, "raw"), (0, "raw")]:
    g, a = from_sum(f"SUM({pos('(x1 + x2) / 2', q)})", q), from_sum(f"SUM({pos('x1', q)} + {pos('x2', q)}) / 2", q)
    b = "beta" if view == "raw" else dis("beta", q, "2.0", "naive", view)
    register(
        f"naive_beta_{qname(q)}_{view}",
        lambda s, d, q=q, view=view: beta.naive_beta(fx.rows_wide(s, d), q, view != "raw", "regional" if view == "raw" else view, repeated=True),
        sql("tab_wide", f"SELECT s1, s2, {r(b, 'value')} FROM (SELECT s1, s2, {g} / {a} beta FROM x GROUP BY s1, s2)", p=P.format(tab="tab_wide"), spine=SPINE, x=DENSE),
    )

register("bray", lambda s, d: beta.bray(fx.rows_wide(s, d), repeated=True), sql("tab_wide", f"SELECT s1, s2, {r('1 - SUM(LEAST(x1, x2))', 'value')} FROM x GROUP BY s1, s2", p=P.format(tab="tab_wide"), spine=SPINE, x=DENSE))
register("jaccard", lambda s, d: beta.jaccard(fx.rows_wide(s, d), repeated=True), sql("tab_wide", f"SELECT s1, s2, {r('1 - CAST(COUNT(*) FILTER (x1 > 0 AND x2 > 0) AS DOUBLE) / COUNT(*)', 'value')} FROM x GROUP BY s1, s2", p=P.format(tab="tab_wide"), spine=SPINE, x=DENSE))

for q in (0, 1, 2):
    g, a = f"SUM(branchL * {pos('(x1 + x2) / 2', q)})", f"SUM(branchL * ({pos('x1', q)} + {pos('x2', q)})) / 2"
    t = "SUM(branchL * (x1 + x2) / 2)"
    register(
        f"phyl_beta_{qname(q)}",
        lambda s, d, q=q: beta.phyl_beta(fx.tab_small(s, d), fx.tree_small(s, d), fx.leaves_small(s, d), q),
        sql(
            "tab_small, tree_small, leaves_small",
            f"SELECT s1, s2, {r(dis('beta', q, '2.0', 'phyl', 'regional'), 'value')} FROM (SELECT s1, s2, {from_sum(f'({g}) / {t}', q)} / {from_sum(f'({a}) / ({t})', q)} beta FROM x GROUP BY s1, s2)",
            p0=P.format(tab="tab_small"), p=A.format(leaves="leaves_small", tree="tree_small").replace("FROM p JOIN", "FROM p0 p JOIN").replace("SUM(p) a", "SUM(p) p").replace("SELECT node,", "SELECT node AS feature,"), spine=SPINE,
            x=DENSE.replace("feature, SUM", "feature, branchL, SUM").replace("s2, feature", "s2, feature, branchL").replace("feature, branchL, branchL", "feature, branchL"),
        ),
    )

for q in (0, 1, 2):
    register(
        f"func_beta_{qname(q)}",
        lambda s, d, q=q: beta.func_beta(fx.tab_small(s, d), fx.distmat(s, d), q),
        sql(
            "tab_small, distmat",
            f"SELECT s1, s2, {r(dis('POW(g / a, 2)', q, '2.0', 'func', 'regional'), 'value')} FROM (SELECT s1, s2, {from_sum('gs / q', q, 2.0)} g, {from_sum('al / q', q, 2.0)} / 2 a FROM (SELECT s1, s2, SUM(d * m1 * m2) q, SUM(d * {pos('m1 * m2', q)}) gs, SUM(d * ({pos('a1 * b1 / 4', q)} + {pos('a2 * b2 / 4', q)} + {pos('a1 * b2 / 4', q)} + {pos('a2 * b1 / 4', q)})) al FROM y GROUP BY s1, s2))",
            p=P.format(tab="tab_small"), spine=SPINE, x=DENSE,
            y="SELECT a.s1, a.s2, d, (a.x1 + a.x2) / 2 m1, (b.x1 + b.x2) / 2 m2, a.x1 a1, a.x2 a2, b.x1 b1, b.x2 b2 FROM x a JOIN x b ON a.s1 = b.s1 AND a.s2 = b.s2 JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature",
        ),
    )

# -- groups

G = "SELECT p.*, region grp FROM p JOIN {meta} USING (sample)"
N = "SELECT grp, COUNT(DISTINCT sample) n FROM g GROUP BY grp"


def group_sql(q: float, div: str) -> str:
    n = "CAST(n AS DOUBLE)"
    return f"SELECT grp, CASE WHEN n >= 2 THEN {n} END n, CASE WHEN n >= 2 THEN {r('beta', 'beta').replace(' AS beta', '')} END beta, CASE WHEN n >= 2 THEN {r(dis('beta', q, n, div, 'local'), 'x').replace(' AS x', '')} END local_dis, CASE WHEN n >= 2 THEN {r(dis('beta', q, n, div, 'regional'), 'x').replace(' AS x', '')} END regional_dis FROM b"


for q in (0, 1, 2):
    register(
        f"naive_multi_beta_{qname(q)}",
        lambda s, d, q=q: beta.naive_multi_beta(fx.tab_wide(s, d), fx.regions(fx.supplier_meta(s, d)), q),
        sql(
            "tab_wide, supplier_meta", group_sql(q, "naive"), p=P.format(tab="tab_wide"), g=G.format(meta="supplier_meta"), n=N, f="SELECT grp, n, feature, SUM(p) / n x FROM g JOIN n USING (grp) GROUP BY grp, n, feature",
            b=f"SELECT grp, n, gamma / alpha * n beta FROM (SELECT grp, n, {from_sum(f'SUM({term('x', q)})', q)} gamma FROM f GROUP BY grp, n) JOIN (SELECT grp, {from_sum(f'SUM({term('p / n', q)})', q)} alpha FROM g JOIN n USING (grp) GROUP BY grp) USING (grp)",
        ),
    )
    register(
        f"phyl_multi_beta_{qname(q)}",
        lambda s, d, q=q: beta.phyl_multi_beta(fx.tab_small(s, d), fx.tree_small(s, d), fx.leaves_small(s, d), fx.regions(fx.nation_meta(s, d)), q),
        sql(
            "tab_small, tree_small, leaves_small, nation_meta", group_sql(q, "phyl"), p=P.format(tab="tab_small"), a=A.format(leaves="leaves_small", tree="tree_small"), g="SELECT a.*, region grp FROM a JOIN nation_meta USING (sample)", n=N,
            f="SELECT grp, n, node, branchL, SUM(a) / n x FROM g JOIN n USING (grp) GROUP BY grp, n, node, branchL",
            b=f"SELECT grp, n, {from_sum('gs / t', q)} / {from_sum('s / (n * t)', q)} beta FROM (SELECT grp, n, SUM(branchL * {term('x', q)}) gs, SUM(branchL * x) t FROM f GROUP BY grp, n) JOIN (SELECT grp, SUM(branchL * {term('a', q)}) s FROM g GROUP BY grp) USING (grp)",
        ),
    )
    register(
        f"func_multi_beta_{qname(q)}",
        lambda s, d, q=q: beta.func_multi_beta(fx.tab_small(s, d), fx.distmat(s, d), fx.regions(fx.nation_meta(s, d)), q),
        sql(
            "tab_small, distmat, nation_meta", group_sql(q, "func"), p=P.format(tab="tab_small"), g=G.format(meta="nation_meta"), n=N, f="SELECT grp, n, feature, SUM(p) / n x FROM g JOIN n USING (grp) GROUP BY grp, n, feature",
            top=f"SELECT a.grp, a.n, SUM(d * a.x * b.x) q, SUM(d * {term('a.x * b.x', q)}) gs FROM f a JOIN f b USING (grp) JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature GROUP BY a.grp, a.n",
            low=f"SELECT a.grp, SUM(d * {term('a.p * b.p / (n * n)', q)}) s FROM g a JOIN g b USING (grp) JOIN n USING (grp) JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature GROUP BY a.grp",
            b=f"SELECT grp, n, {from_sum('gs / q', q, 2.0)} / ({from_sum('s / q', q, 2.0)} / n) beta FROM top JOIN low USING (grp)",
        ),
    )

register(
    "beta_profile",
    lambda s, d: beta.beta_profile(fx.tab_small(s, d), fx.regions(fx.nation_meta(s, d))),
    sql(
        "tab_small, nation_meta", f"SELECT CAST(k AS DOUBLE) / 20 q, grp, {r('gamma / alpha * n', 'beta')} FROM top JOIN low USING (grp, k) WHERE n >= 2", p=P.format(tab="tab_small"), g=G.format(meta="nation_meta"), n=N, f="SELECT grp, n, feature, SUM(p) / n x FROM g JOIN n USING (grp) GROUP BY grp, n, feature", grid="SELECT UNNEST(RANGE(0, 41)) k",
        top="SELECT grp, n, k, CASE WHEN k = 20 THEN EXP(-SUM(x * LN(x))) ELSE POW(SUM(POW(x, k / 20.0)), 1 / NULLIF(1 - k / 20.0, 0)) END gamma FROM f, grid GROUP BY grp, n, k",
        low="SELECT grp, k, CASE WHEN k = 20 THEN EXP(-SUM(p / n * LN(p / n))) ELSE POW(SUM(POW(p / n, k / 20.0)), 1 / NULLIF(1 - k / 20.0, 0)) END alpha FROM g JOIN n USING (grp), grid GROUP BY grp, k",
    ),
)

for q, index in [(1, "regional"), (2, "regional"), (2, "local")]:
    ds = from_sum(f"SUM({term('v / vs', q)})", q)
    z = f"SUM(POW(v, {q}))" if index == "local" else f"POW(SUM(v), {q})"
    ev = even("d", "CAST(n AS DOUBLE)", q, index)
    for kind in ("naive", "phyl"):
        if kind == "naive":
            rows = "SELECT region grp, feature, sample, value v, 1.0::DOUBLE branchL, SUM(value) OVER (PARTITION BY region, feature) vs FROM tab_small JOIN nation_meta USING (sample)"
            run = lambda s, d, q=q, index=index: beta.dissimilarity_by_feature(fx.tab_small(s, d), fx.regions(fx.nation_meta(s, d)), q, index)
        else:
            rows = "SELECT region grp, node feature, sample, a v, branchL, SUM(a) OVER (PARTITION BY region, node) vs FROM a JOIN nation_meta USING (sample)"
            run = lambda s, d, q=q, index=index: beta.dissimilarity_by_feature(fx.tab_small(s, d), fx.regions(fx.nation_meta(s, d)), q, index, div_type="phyl", tree=fx.tree_small(s, d), node_leaf=fx.leaves_small(s, d))
        register(
            f"dissimilarity_by_feature_{kind}_{qname(q)}_{index}",
            run,
            sql(
                "tab_small, nation_meta, tree_small, leaves_small",
                f"SELECT grp, feature, CAST(n AS DOUBLE) n, {r('SUM(part) OVER (PARTITION BY grp)', 'dis')}, {r('100 * part / NULLIF(SUM(part) OVER (PARTITION BY grp), 0)', 'pct')} FROM (SELECT grp, n, feature, branchL * z / SUM(z) OVER (PARTITION BY grp) * (1 - {ev}) part FROM (SELECT grp, feature, branchL, {ds} d, branchL * {z} z FROM g GROUP BY grp, feature, branchL) x JOIN n USING (grp) WHERE n >= 2)",
                p=P.format(tab="tab_small"), a=A.format(leaves="leaves_small", tree="tree_small"), g=rows, n="SELECT region grp, COUNT(DISTINCT sample) n FROM tab_small JOIN nation_meta USING (sample) GROUP BY 1",
            ),
        )

# -- relatedness

W2 = "SELECT a.sample s1, b.sample s2, a.feature f1, b.feature f2, a.p p1, b.p p2, d FROM p a JOIN p b ON a.sample <> b.sample JOIN distmat m ON m.f1 = a.feature AND m.f2 = b.feature"
for q in (0, 1):
    register(
        f"beta_mpd_{qname(q)}",
        lambda s, d, q=q: beta.beta_mpd(fx.tab_small(s, d), fx.distmat(s, d), q),
        sql("tab_small, distmat", f"SELECT s1, s2, {r('g / (a.z * b.z)', 'value')} FROM (SELECT s1, s2, SUM(d * POW(p1, {q}) * POW(p2, {q})) g FROM x WHERE s1 < s2 GROUP BY s1, s2) JOIN z a ON a.sample = s1 JOIN z b ON b.sample = s2", p=P.format(tab="tab_small"), x=W2, z=f"SELECT sample, SUM(POW(p, {q})) z FROM p GROUP BY sample"),
    )
    for con in (False, True):
        x = W2 if not con else W2 + " UNION ALL SELECT a.sample, b.sample, feature, feature, a.p, b.p, CAST(0 AS DOUBLE) FROM p a JOIN p b USING (feature) WHERE a.sample <> b.sample"
        register(
            f"beta_mntd_{qname(q)}" + "_conspecifics" * con,
            lambda s, d, q=q, con=con: beta.beta_mntd(fx.tab_small(s, d), fx.distmat(s, d), q, con),
            sql(
                "tab_small, distmat", f"SELECT LEAST(s1, s2) s1, GREATEST(s1, s2) s2, {r('SUM(v) / 2', 'value')} FROM v GROUP BY ALL", p=P.format(tab="tab_small"), x=x,
                v=f"SELECT s1, s2, SUM(POW(p1, {q}) * near) / z v FROM (SELECT s1, s2, f1, p1, MIN(d) near FROM x GROUP BY s1, s2, f1, p1) JOIN (SELECT sample, SUM(POW(p, {q})) z FROM p GROUP BY sample) ON sample = s1 GROUP BY s1, s2, z",
            ),
        )

# -- trees

register("tree_closure", lambda s, d: trees.closure(fx.tree_small(s, d)), sql("leaves_small", "SELECT node, leaf FROM leaves_small"))
register("tree_dist_to_root", lambda s, d: trees.dist_to_root(fx.tree_small(s, d)), sql("tree_small", f"SELECT node, {r("CAST(CASE WHEN parent IS NULL THEN 0 WHEN parent = 'root' THEN 0.7 ELSE 1.0 END AS DOUBLE)", 'dist_to_root')} FROM tree_small"))


def _tree_distance(s, d):
    t = fx.tree_small(s, d)
    return trees.tree_distance(t.drop("dist_to_root").join(trees.dist_to_root(t), "node"), fx.leaves_small(s, d))


register(
    "tree_distance",
    _tree_distance,
    sql(
        "tree_small, leaves_small", f"SELECT f1, f2, {r('SUM(branchL)', 'd')} FROM p JOIN tree_small t ON EXISTS (SELECT 1 FROM leaves_small l WHERE l.node = t.node AND l.leaf = f1) <> EXISTS (SELECT 1 FROM leaves_small l WHERE l.node = t.node AND l.leaf = f2) GROUP BY f1, f2",
        p="SELECT a.node f1, b.node f2 FROM tips_small a JOIN tips_small b ON a.node < b.node",
    ),
)
register(
    "tree_distance_types",
    lambda s, d: trees.tree_distance(fx.tree_types(s, d), trees.closure(fx.tree_types(s, d))),
    sql("", f"SELECT a.node f1, b.node f2, {r('a.l + b.l + CASE WHEN a.parent = b.parent THEN 0 ELSE 1.0::DOUBLE END', 'd')} FROM t a JOIN t b ON a.node < b.node", t="SELECT p_type || '/' || p_brand node, p_type parent, AVG(CAST(p_size AS DOUBLE)) / 50 l FROM part GROUP BY ALL"),
)
register(
    "tree_tour",
    lambda s, d: trees.tour(fx.tree_large(s, d), fx.leaves_large(s, d)).select("node", "leaves", "first", "depth"),
    sql(
        "", f"SELECT node, COUNT(*) leaves, MIN(k) - 1 AS \"first\", {r('ANY_VALUE(h)', 'depth')} FROM (SELECT k, UNNEST([tip, brand, type, 'root']) node, UNNEST([1.0::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE]) h FROM o) GROUP BY node",
        o="SELECT *, ROW_NUMBER() OVER (ORDER BY type, brand, tip) k FROM (SELECT CAST(p_partkey AS VARCHAR) tip, p_type || '/' || p_brand brand, p_type AS type FROM part)",
    ),
)
register(
    "prune_tree",
    lambda s, d: trees.prune(fx.tree_large(s, d), fx.leaves_large(s, d), fx.tax(s, d).where("Phylum is null")),
    sql(
        "tax", f"SELECT node, parent, {r('branchL', 'branchL')} FROM o",
        k="SELECT CAST(p_partkey AS VARCHAR) tip, p_type || '/' || p_brand brand, p_type AS type FROM part JOIN tax ON feature = CAST(p_partkey AS VARCHAR) WHERE \"Phylum\" IS NULL",
        c="SELECT *, COUNT(*) OVER (PARTITION BY brand) nb, nt FROM k JOIN (SELECT type, COUNT(DISTINCT brand) nt FROM k GROUP BY type) USING (type)",
        o="SELECT tip node, CASE WHEN nb > 1 THEN brand WHEN nt > 1 THEN type ELSE 'root' END parent, 0.2::DOUBLE + CASE WHEN nb > 1 THEN 0 WHEN nt > 1 THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END \"branchL\" FROM c UNION ALL SELECT DISTINCT brand, CASE WHEN nt > 1 THEN type ELSE 'root' END, 0.3::DOUBLE + CASE WHEN nt > 1 THEN 0 ELSE 0.5::DOUBLE END FROM c WHERE nb > 1 UNION ALL SELECT DISTINCT type, 'root', 0.5::DOUBLE FROM c WHERE nt > 1 UNION ALL SELECT 'root', NULL, 0",
    ),
)


def _heights(tree):
    tips = tree.select("node").join(tree.select(F.col("parent").alias("node")), "node", "left_anti")
    tall = trees.dist_to_root(tree).join(tips, "node").agg(F.max("dist_to_root").alias("height"), F.count(F.lit(1)).alias("leaves"))
    return tall.join(F.broadcast(tree.agg(F.sum("branchL").alias("length"))))  # one row each


register(
    "prune_reroot",
    lambda s, d: _heights(trees.reroot_midpoint(fx.tree_uneven(s, d), fx.leaves_large(s, d))),
    sql(
        "", f"SELECT {r('MAX(a.l + b.l + CASE WHEN a.brand = b.brand THEN 0 WHEN a.type = b.type THEN 0.6::DOUBLE ELSE 1.6::DOUBLE END) / 2', 'height')}, (SELECT COUNT(*) FROM t) leaves, {r('(SELECT SUM(l) + 0.3::DOUBLE * COUNT(DISTINCT brand) + 0.5::DOUBLE * COUNT(DISTINCT type) FROM t)', 'length')} FROM t a JOIN t b ON a.k < b.k",
        t="SELECT p_partkey k, p_type || '/' || p_brand brand, p_type AS type, 0.2::DOUBLE + p_size / 10.0::DOUBLE l FROM part",
    ),
)
register(
    "subset_tree",
    lambda s, d: trees.subset_tree_rows(fx.tree_large(s, d), fx.leaves_large(s, d), fx.tax(s, d).where("Phylum is null")),
    sql("tree_large, leaves_large, tax", "SELECT node, parent, branchL, COUNT(*) n_leaves FROM tree_large JOIN leaves_large USING (node) WHERE leaf IN (SELECT feature FROM tax WHERE \"Phylum\" IS NULL) GROUP BY ALL"),
)
register(
    "collapse_tree",
    lambda s, d: trees.collapse_single_children(fx.tree_large(s, d), fx.leaves_large(s, d)),
    sql("tree_large, leaves_large", f"SELECT leaves, {r('SUM(branchL)', '\"branchL\"')} FROM (SELECT node, branchL, STRING_AGG(leaf, ',' ORDER BY leaf) leaves FROM tree_large JOIN leaves_large USING (node) GROUP BY ALL) GROUP BY leaves"),
)
register(
    "rename_leaves",
    lambda s, d: trees.rename_leaves(fx.tree_small(s, d), fx.tree_small(s, d).where("node like 'Brand%'").select(F.col("node").alias("old"), F.concat(F.lit("tip_"), "node").alias("new"))),
    sql("tree_small", "SELECT CASE WHEN node LIKE 'Brand%' THEN 'tip_' || node ELSE node END node, parent, branchL FROM tree_small"),
)
