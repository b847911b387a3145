"""Masking of personal data, and one text with very many spans."""

from biotally.llm import pii

DOCS = "doc_id long, text string, kind string, spans int"


def test_mask(spark):
    rows = [(1, "mail a@b.co or call +1 555 123 4567 now"), (2, None), (3, ""), (4, "nothing here"), (5, "4111 1111 1111 1111 and 1.2.3.4"), (6, "a@b.co" * 1), (6, "a@b.co é😀 a@b.co"), (7, "x@y.zz " * 20_000)]
    got = [(r["doc_id"], r["text"]) for r in pii.mask(spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS)).collect()]
    assert got[0][1] == "mail [email] or call [phone] now"
    assert got[1:4] == [(2, None), (3, ""), (4, "nothing here")]
    assert got[4][1] == "[card] and [ip]"
    assert got[5:7] == [(6, "[email]"), (6, "[email] é😀 [email]")]
    assert got[7][1] == "[email] " * 20_000
    assert pii.mask(spark.createDataFrame([], DOCS)).collect() == []
