"""The pipeline's stages, each against the operator's brute force on what it is given."""

import collections

import pytest
from pyspark.sql import functions as F
from test_corpus import ODD, brute_ids, brute_secrets, brute_targets, odd, rows_of  # noqa: F401
from test_near_copies import kept_by_brute_force
from test_quality import forest_by_hand

import corpus_pipeline
from biotally.llm import packing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before.toPandas(), docs.toPandas()
    before, after = seen["quality"]
    scores = forest_by_hand(spark, before, f"{SF}/labels.parquet")
    assert sorted(after.doc_id) == sorted(d for d, x in zip(before.doc_id, scores, strict=True) if x >= 0.5)
    before, after = seen["near_duplicates"]
    assert sorted(after.doc_id) == kept_by_brute_force(before.doc_id.tolist(), before.text.tolist())
    before, after = seen["secrets"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and not any(brute_secrets(t) for t in after.text)
    same = {d for d, t in zip(before.doc_id, before.text, strict=True) if not brute_secrets(t)}
    assert {d for d, t in zip(before.doc_id, before.text, strict=True) if d in same and t in set(after.text)} == same
    before, after = seen["mixing"]
    size = {d: len((t or "").split()) for d, t in zip(before.doc_id, before.text, strict=True)}
    per, taken = collections.Counter(), collections.Counter()
    for d, src in zip(before.doc_id, before.source, strict=True):
        per[src] += size[d]
    copies = collections.Counter(after.doc_id)
    for src, t in zip(after.source, after.text, strict=True):
        taken[src] += len(t.split())
    assert all(abs(taken[src] - n) <= 1 for src, n in brute_targets(per).items()) and max(copies.values()) <= 3
    whole = dict(zip(before.doc_id, before.text, strict=True))
    assert all(whole[d].startswith(t) for d, t in zip(after.doc_id, after.text, strict=True))
    before, after = seen["packing"]
    want = collections.Counter()
    for d, ids in zip(before.doc_id, brute_ids(before.text.fillna("").tolist()), strict=True):
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d, k, at, len(ids[at : at + 4096])] += 1
    assert collections.Counter(zip(after.doc_id, after.piece, after.start, after.length, strict=True)) == want
    room = collections.Counter()
    for s, n in zip(after.sequence_id, after.length, strict=True):
        room[s] += n
    assert max(room.values()) <= 4096 and after.sequences[0] == len(room) and after.sequences_bound[0] <= len(room)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_tables(spark, odd, rows):  # noqa: F811
    docs = odd if rows == "odd" else odd.limit(0)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        kept = out.count()
        assert kept == 0 if rows == "none" else kept > 0
        if name == "secrets":
            assert kept == n
        # The odd rows are not those that labels know: later stages get them all.
        docs, n = (docs, n) if name == "quality" else (out, kept)
