"""The registered queries: their columns, their rows, and those with SQL against it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# The columns that each contract names, in its types.
COLUMNS = {
    "op1_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op3_licenses": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op4_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_substring": "doc_id bigint, start bigint, end bigint, first_doc_id bigint",
    "op7_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op11_collocations": "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_main_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = entry.queries()[name](spark, SF)
    have = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        c, t = column.split()
        assert have[c] == t
    if name not in ("op1_packing", "op4_topk", "op6_substring", "op11_collocations", "op12_whitening", "op13_main_text"):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", ["op2_mixing", "op4_topk", "op10_secrets", "op11_collocations"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    got, want = sorted(tuple(r) for r in df.select(*cols).collect()), sorted(rel.fetchall())
    assert len(got) == len(want)
    assert all(x == y or math.isclose(x, y, abs_tol=1e-5) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
