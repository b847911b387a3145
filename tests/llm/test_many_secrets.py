"""One text with very many secrets."""

import time

import pytest
from pyspark.sql import functions as F

from biotally.llm import secrets
from biotally.llm.common import running

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 99, 1000])
def test_running(spark, n):
    values = [(7 * k) % 13 - 3 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m")).first()
    assert got["s"] == [sum(values[: k + 1]) for k in range(n)]
    assert got["m"] == [max(values[: k + 1]) for k in range(n)]


def test_a_key_dump(spark):
    n = 100_000
    line = "é key AKIA%016d and\n"
    text = "".join(line % k for k in range(n))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "clean", "en", "s", 5)], DOCS)
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.scan(docs).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).where("n > 0").collect()}
    last = text.rindex("AKIA")
    assert (got[1]["n"], got[1]["last"]["start"], got[1]["last"]["end"]) == (n, last, last + 20)
    clean = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert clean[1]["text"] == "é key [access] and\n" * n
    assert clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] == "clean"
    assert time.time() - began < 300  # with the quadratic form it did not end


@pytest.mark.parametrize("gap", [0, 1, 1000, 1023, 1024, 1025, 5000])
def test_cuts_at_edges_of_parts(spark, gap):
    secret = "password=hunter2hunter2"
    text = "x " * (gap // 2) + "é" * (gap % 2) + " " + secret + " " + "😀" * gap + " " + secret
    got = secrets.redact(spark.createDataFrame([(1, text, "en", "s", len(text))], DOCS)).first()
    assert got["text"] == text.replace(secret, "[assign]")
    assert got["n_chars"] == len(got["text"])
