"""The order of reads by keys, sample by sample in one task, against the form by
parts, which larger samples take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biotally.operators import relational, thinning


@pytest.fixture(scope="module")
def tab(spark):
    rng = np.random.default_rng(3)
    cells = [(f"f{i}", f"s{j}", float(rng.integers(1, 60))) for i in range(25) for j in range(6) if rng.random() < 0.7]
    return spark.createDataFrame([*cells, (None, "s1", 7.0), ("f1", "alone", 1.0)], "feature string, sample string, value double").cache()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("whole", [0, 600])
def test_either_form(tab, monkeypatch, whole):
    depths = relational.sample_depths(tab).select("sample", F.explode(F.expr("array(1, total div 3, total - 1, total)")).alias("depth")).where("depth > 0").distinct()
    got = rows(relational.first_reads(tab, depths, 4).select("sample", "depth", "feature", "n"))
    monkeypatch.setattr(thinning, "WHOLE", whole)
    assert got == rows(relational.first_reads(tab, depths, 4).select("sample", "depth", "feature", "n")) and len(got) > 300


def test_no_read_is_shuffled(tab, monkeypatch):
    """Parts, which shuffle keys and a row a cell and depth, are for large samples."""
    want = rows(relational.rarefaction_curve(tab.where("feature is not null"), 1, 7))
    monkeypatch.setattr(relational, "_first_by_parts", None)
    assert rows(relational.rarefaction_curve(tab.where("feature is not null"), 1, 7)) == want


def test_equal_keys_are_in_the_order_of_the_counts(monkeypatch):
    monkeypatch.setattr(thinning.digests, "numbered", lambda names, which, i: np.zeros((len(i), 16), dtype=np.uint8))
    found = thinning.keyed_firsts(np.array([2, 3, 1]), np.array([1, 3, 6]), [b"a", b"b", b"c"])
    assert found.tolist() == [[1, 0, 0], [2, 1, 0], [2, 3, 1]]
