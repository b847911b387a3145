"""SINTAX files in splits of any size, against a plain reading; ranks a file has."""

import random

import pytest

from biotally.sources import text


def plain(lines):
    """Ids and texts of a file's lines, one after the other."""
    lines, out, k = [x.strip("\r\n") for x in lines if x.strip()], [], 0
    while k < len(lines):
        if "\t" in lines[k]:
            out.append((lines[k].split("\t")[0].strip().removeprefix(">"), lines[k]))
            k += 1
        else:
            if k + 1 < len(lines):
                out.append((lines[k].strip().removeprefix(">"), lines[k + 1]))
            k += 2
    return out


@pytest.mark.parametrize("split", ["64b", "1k", "128m"])
def test_records_in_splits(spark, tmp_path, split):
    rng, want = random.Random(6), []
    for f in range(3):
        lines = []
        for k in range(40):
            tail = f"d:Bac(1.00)\t+\td:B{k},p:P{f}"
            lines += [[f"f{f}_{k}\t{tail}"], [f">f{f}_{k}", tail], [f"f{f}_{k}", "no taxonomy"], ["", f"x{f}_{k}"], [f"f{f}_{k}", f"y\t{tail}\r"]][rng.randrange(5)]
        (tmp_path / f"{f}.txt").write_text("\n".join(lines) + ("\n" if f else ""))
        want += plain(lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r) for r in text.sintax_records(text.file_lines(spark, str(tmp_path))).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(want) and len(want) > 60


def test_kingdom(spark, tmp_path):
    (tmp_path / "s.txt").write_text("a\tk:Bac(1)\t+\tk:Bac,p:Fir\nb\tk:Bac(1)\n")
    got = text.read_sintax(spark, str(tmp_path / "s.txt"))
    assert got.columns == ["feature", "Kingdom", "Phylum"]
    assert sorted(map(tuple, got.collect())) == [("a", "k__Bac", "p__Fir"), ("b", None, None)]
    (tmp_path / "q.tsv").write_text("Feature ID\tTaxon\na\tk__Bac; p__Fir; g__\nb\tUnassigned\n")
    got = text.read_qiime(spark, str(tmp_path / "q.tsv"))
    assert got.columns == ["feature", "Kingdom", "Phylum", "Genus"]
    assert sorted(map(tuple, got.collect())) == [("a", "Bac", "Fir", ""), ("b", "", "", "")]


def test_no_records(spark, tmp_path):
    (tmp_path / "s.txt").write_text("\n\n")
    assert text.read_sintax(spark, str(tmp_path / "s.txt")).collect() == []
