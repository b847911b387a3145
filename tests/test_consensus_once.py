"""Consensus reads each table once: features are numbered once, cells are not shuffled for shares."""

import pytest

from biotally.operators import combine


@pytest.fixture
def objects(spark):
    one = {"tab": spark.createDataFrame([("a", "x", 8.0), ("b", "x", 1.0), ("b", "y", 1.0), ("c", "y", 90.0)], "feature string, sample string, value double"), "seq": spark.createDataFrame([("a", "AC"), ("b", "AC"), ("c", "GG")], "feature string, seq string")}
    two = {"tab": spark.createDataFrame([("k", "x", 3.0), ("l", "z", 1.0)], "feature string, sample string, value double"), "seq": spark.createDataFrame([("k", "AC"), ("l", "TT")], "feature string, seq string")}
    return [one, two]


def test_numbered_once_and_named(monkeypatch, objects):
    seen, plain = [], combine.numbered
    monkeypatch.setattr(combine, "numbered", lambda df, name, *order: seen.append(name) or plain(df, name, *order))
    made, info = combine.consensus(objects, keep_cutoff=95.0)
    assert seen == ["ord", "n", "n"]  # "ord" twice before
    assert sorted(map(tuple, info.collect())) == [(0, 1, 10.0, False), (1, 1, 75.0, True)]
    assert sorted(map(tuple, made["tab"].collect())) == [("SV1", "x", 3.0), ("SV2", "z", 1.0)]
    made, _ = combine.consensus(objects, keep_object=0, keep_cutoff=99.5)
    assert sorted(map(tuple, made["tab"].collect())) == [("SV1", "x", 9.0), ("SV1", "y", 1.0)]
    assert [tuple(r) for r in made["seq"].collect()] == [("SV1", "AC")]


def test_info_alone(objects):
    want = sorted(map(tuple, combine.consensus(objects)[1].collect()))
    info = combine.consensus_info(objects)
    assert sorted(map(tuple, info.collect())) == want
    aligned = combine.align(objects)
    assert sorted(map(tuple, combine.consensus_info(aligned, already_aligned=True).collect())) == want
