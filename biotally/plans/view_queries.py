"""Queries of the data behind figures, with their oracles."""

from __future__ import annotations

from ..operators import beta, views
from . import fixtures as fx
from .diversity_queries import P
from .registry import ORACLES, r, register, sql

_CONTRIB = ORACLES["dissimilarity_by_feature_naive_q1_regional"]
register(
    "dissimilarity_contributions",
    lambda s, d: views.top_contributions(beta.dissimilarity_by_feature(fx.tab_small(s, d), fx.regions(fx.nation_meta(s, d)), 1), 5),
    f"WITH c AS ({_CONTRIB}) SELECT grp, feature, pct FROM c WHERE feature IN (SELECT feature FROM c GROUP BY feature ORDER BY ROUND(AVG(pct), 6) DESC, feature LIMIT 5)",
)
register(
    "phyl_tree_abundance",
    lambda s, d: views.tip_abundance(fx.tab_wide(s, d), fx.regions(fx.supplier_meta(s, d))),
    sql("tab_wide, supplier_meta", f"SELECT feature, region grp, {r('100 * SUM(p) / n', 'pct')} FROM p JOIN supplier_meta USING (sample) JOIN (SELECT region, COUNT(*) n FROM supplier_meta WHERE sample IN (SELECT sample FROM tab_wide) GROUP BY 1) USING (region) GROUP BY feature, region, n", p=P.format(tab="tab_wide")),
)
register(
    "harvey_balls",
    lambda s, d: views.clipped(fx.supplier_meta(s, d).selectExpr("sample", "acctbal / 50 AS pct")),
    sql("supplier_meta", f"SELECT sample, {r('GREATEST(0.0, LEAST(100.0, acctbal / 50))', 'pct')} FROM supplier_meta"),
)
register(
    "design_matrix",
    lambda s, d: views.design_matrix(fx.nation_meta(s, d), ["n_suppliers", "mean_acctbal"], ["region"]),
    sql(
        "nation_meta", f"SELECT sample, variable, {r('value - AVG(value) OVER (PARTITION BY variable)', 'value')} FROM x",
        x="SELECT sample, 'n_suppliers' AS variable, CAST(n_suppliers AS DOUBLE) AS value FROM nation_meta UNION ALL SELECT sample, 'mean_acctbal', mean_acctbal FROM nation_meta UNION ALL SELECT sample, 'region=' || l, CASE WHEN region = l THEN 1 ELSE 0 END FROM nation_meta, (SELECT DISTINCT region l FROM nation_meta WHERE region <> (SELECT MIN(region) FROM nation_meta))",
    ),
)
