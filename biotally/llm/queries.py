"""The registered queries of the corpus operators, at production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, fingerprints, html_text, licenses, mixing, packing, pii, quality, secrets, simhash, substring, topk, whitening
from .common import table


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_key", "source_key").withColumn("target", F.round("target", 6))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), licenses.labels(base).alias("base_labels"), licenses.labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))

    return found.select("doc_id", *[_count(k) for k in pii.BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).drop("text_key")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compared(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), fingerprints.listed(F.col("anchors")).alias("fingerprint"), fingerprints.listed(F.col("edited_anchors")).alias("edited_fingerprint"),
        fingerprints.alike(F.col("anchors.hashes"), F.col("edited_anchors.hashes")).alias("near_edited"), fingerprints.alike(F.col("anchors.hashes"), F.col("next_anchors")).alias("near_next"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    return found.select("doc_id", *[_count(k) for k in secrets.BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "e"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("e.whitened").alias("whitened"), F.col("e.explained").alias("explained"), "identity_error")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_licenses, op4_topk, op5_pii, op6_substring, op7_fingerprints, op8_quality, op9_simhash, op10_secrets, op11_collocations, op12_whitening, op13_main_text)}

# -- SQL for the oracle, where SQL can say it: fingerprints and simhashes need
# XXH64, packing a tokenizer, quality a trained forest, licences the rarity of
# words in an index, personal data look-around patterns, whitening eigenvectors,
# main text a trained model.

_OP2 = rf"""
WITH d AS (
    SELECT doc_id, COALESCE(text, '') AS t, source, len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
    SELECT source, SUM(size)::DOUBLE AS ss, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
    SELECT source, ss, [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS w, 3 * ss AS cap, 3 * ss / [5.0, 2.0, 1.0][n % 3 + 1]::DOUBLE AS ratio, SUM(ss) OVER () AS total FROM s
), l AS (
    SELECT *, (total - COALESCE(SUM(cap) OVER b, 0)) / (SUM(w) OVER () - COALESCE(SUM(w) OVER b, 0)) AS level FROM w
    WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
    SELECT source, ss, LEAST(cap, w * COALESCE((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), ratio)) AS target FROM l
), k AS (
    SELECT d.doc_id, d.size, d.source, g.ss, g.target, md5(t) AS h, -LN((('0x' || SUBSTR(MD5(CONCAT_WS(':', '17', COALESCE(CAST(doc_id AS VARCHAR), ''), MD5(t))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / (0.25::DOUBLE + LENGTH(regexp_replace(t, '[\x00-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / GREATEST(LENGTH(t), 1)) AS e
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), c AS (
    SELECT *, CASE WHEN ss > 0 THEN FLOOR(ROUND(target) / ss) ELSE 0 END AS ep, SUM(size) OVER (PARTITION BY source ORDER BY e, doc_id, h ROWS UNBOUNDED PRECEDING) - size AS b FROM k
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, ROUND(target, 6) AS target, CAST(ep * size + GREATEST(0, LEAST(size, ROUND(target) - ep * ss - b)) AS BIGINT) AS taken FROM c
"""

_OP4 = """
WITH e AS (
    SELECT ROW_NUMBER() OVER () AS n, vec_id, list_transform(embedding, lambda x: FLOOR(64 * CAST(x AS DOUBLE))::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(k AS INT) AS rank, vec_id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM p) WHERE k <= 20
"""


def _op11() -> str:
    lengths = range(1, collocations.LONGEST + 1)
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, UNNEST(range(1, len(w) - {k - 2})) AS i FROM p)" for k in lengths)
    return rf"""
WITH t AS (
    SELECT COALESCE(lang, 'und') AS lang, UNNEST(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), g AS (
    SELECT lang, k, phrase, COUNT(*) AS a FROM ({grams}) GROUP BY ALL
), n AS (SELECT lang, SUM(a)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang
), f AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM g WHERE a >= {collocations.LEAST}
), c AS (
    SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, UNNEST(range(1, k)) AS cut FROM f WHERE k > 1)
), s AS (
    SELECT c.*, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y
), b AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, MAX(a) AS most FROM (SELECT *, UNNEST(range(1, k - m + 2)) AS i FROM (SELECT *, UNNEST(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL
), o AS (
    SELECT b.*, ROW_NUMBER() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.most IS NULL OR 100 * i.most < {collocations.WITHIN} * b.a
)
SELECT o.lang, CAST(rank AS INT) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= {collocations.KEEP}
"""


def _op10() -> str:
    """Match places from the gaps between matches, rule by rule."""
    q = lambda s: s.replace("'", "''")
    each = []
    for n, rule in enumerate(secrets.RULES):
        found, gaps = f"regexp_extract_all(t, '{q(rule.pattern)}')", f"string_split_regex(t, '{q(rule.pattern)}')"
        value = f"regexp_extract_all(t, '{q(rule.pattern)}', {rule.group})"
        each.append(
            f"SELECT r, doc_id, {n} AS n, '{rule.kind}' AS kind, list_sum(list_transform(g[1:k], lambda x: len(x))) + COALESCE(list_sum(list_transform(f[1:k - 1], lambda x: len(x))), 0) AS a, len(f[k]) AS l FROM "
            f"(SELECT r, doc_id, {found} AS f, {gaps} AS g, {value} AS v, UNNEST(range(1, len({found}) + 1)) AS k FROM d WHERE regexp_matches(t, '{q(rule.pattern)}')) WHERE len(v[k]) >= {rule.least}"
        )
    cell = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + l AS BIGINT)"
    counts = ", ".join(f"COUNT(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, COALESCE(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(each)})
SELECT d.doc_id, {counts}, sha256(COALESCE(STRING_AGG({cell}, ',' ORDER BY a, n) FILTER (n < {len(secrets.BASE)}), '')) AS base_sha256, COALESCE(STRING_AGG({cell}, ',' ORDER BY a, n), '') AS spans FROM d LEFT JOIN m USING (r) GROUP BY d.r, d.doc_id
"""


ORACLES: dict[str, str] = {"op2_mixing": _OP2, "op4_topk": _OP4, "op10_secrets": _op10(), "op11_collocations": _op11()}
