"""Which sequences hold which, and which are within a few edits of each other.

Neither compares all pairs. A sequence that another holds shares every piece
with it, so that it is looked up by its rarest piece alone. Two sequences within
k edits share one of k + 1 segments of the shorter one, nearly in its place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered, settled

#: Features of one sequence that are held in a row, at most.
MEMBERS = 1024
#: Lengths of pieces: a sequence is looked up by pieces of the longest that it has.
PIECES = (1, 2, 4, 8, 16, 32)


def _pieces(text: Column, size: int) -> Column:
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containments(seqs: DataFrame) -> DataFrame:
    """(inner, outer): ids of distinct sequences (id, seq) of which the second
    holds the first. An inverted index has the pieces of every sequence; each is
    looked up by the one of its own pieces that the fewest sequences have. An
    empty sequence is held by all."""
    size = F.lit(0)
    for p in PIECES:
        size = F.when(F.length("seq") >= p, p).otherwise(size)
    sized = seqs.where("seq is not null").select("id", "seq", size.alias("size"))
    classes = sorted(r[0] for r in sized.select("size").distinct().collect())  # of a handful
    index = None
    for p in classes:
        grams = F.array(F.lit("")) if p == 0 else _pieces(F.col("seq"), p)
        rows = sized.where(F.length("seq") >= p).select("id", "seq", F.lit(p).alias("size"), F.explode(grams).alias("piece"))
        index = rows if index is None else index.unionByName(rows)
    if index is None:
        return seqs.sparkSession.createDataFrame([], "inner long, outer long")
    counts = index.groupBy("size", "piece").agg(F.count(F.lit(1)).alias("n"))
    own = sized.select("id", "seq", "size").withColumn("piece", F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(_cased(classes))))
    rarest = own.join(counts, ["size", "piece"]).groupBy("id", "seq", "size").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    inner = rarest.select(F.col("id").alias("inner"), F.col("seq").alias("inner_seq"), "size", "piece")
    outer = index.select(F.col("id").alias("outer"), F.col("seq").alias("outer_seq"), "size", "piece")
    met = inner.join(outer, ["size", "piece"]).where((F.col("inner") != F.col("outer")) & (F.length("outer_seq") >= F.length("inner_seq")) & F.contains("outer_seq", "inner_seq"))
    return met.select("inner", "outer")


def _cased(classes: list[int]) -> Column:
    """Pieces of a sequence's own class."""
    out = F.array().cast("array<string>")
    for p in classes:
        if p:
            out = F.when(F.col("size") == p, _pieces(F.col("seq"), p)).otherwise(out)
    return out


def _segments(n: Column, k: int) -> list[tuple[Column, Column]]:
    """(start from 0, length) of the k + 1 segments of a sequence of length n:
    as even as can be, longer ones last."""
    short = F.floor(n / (k + 1)).cast("int")
    longer = n - short * (k + 1)
    out = []
    for i in range(k + 1):
        before = F.greatest(F.lit(0), F.lit(i) - (F.lit(k + 1) - longer))
        out.append((short * i + before, short + F.when(F.lit(i) >= F.lit(k + 1) - longer, 1).otherwise(0)))
    return out


def similar(seq: DataFrame, k: int) -> DataFrame:
    """f1 < f2, distance, normalized: the pairs within ``k`` edits. Equal
    sequences meet as one; pairs further apart are never made, unless they share
    a segment. Segment i of the shorter is looked up in the longer only where at
    most i edits before it and k - i behind it can have moved it."""
    if k < 0:
        raise ValueError("k must not be negative")
    rows = seq.select("feature", F.coalesce("seq", F.lit("")).alias("seq"))
    texts = rows.select("seq").distinct()
    n = F.length("seq")
    # Of up to k letters no segment is left: those meet all of up to 2 k by one key.
    cut = texts.where(n > k)
    own = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("seq", a + 1, w).alias("piece")) for i, (a, w) in enumerate(_segments(n, k))])
    index = cut.select(F.col("seq").alias("q1"), n.alias("n"), F.inline(own))
    probes = []
    for gap in range(k + 1):
        shorter = n - gap
        for i, (a, w) in enumerate(_segments(shorter, k)):
            for p in range(max(-i, gap - (k - i)), min(i, gap + (k - i)) + 1):
                at = a + p
                probes.append(F.when((shorter > k) & (at >= 0) & (at + w <= n), F.struct(shorter.alias("n"), F.lit(i).alias("i"), F.substring("seq", at + 1, w).alias("piece"))))
    probe = texts.select(F.col("seq").alias("q2"), F.inline(F.array_distinct(F.array_compact(F.array(*probes)))))
    met = index.join(probe, ["n", "i", "piece"]).where((F.col("q1") != F.col("q2")) & ((F.length("q1") < F.length("q2")) | (F.col("q1") < F.col("q2"))))
    pairs = met.select("q1", "q2").distinct()
    if k:
        tiny, small = texts.where(n <= k).select(F.col("seq").alias("q1")), texts.where(n <= 2 * k).select(F.col("seq").alias("q2"))
        lone = tiny.join(small, F.length("q2") - F.length("q1") <= k).where((F.length("q1") < F.length("q2")) | ((F.length("q1") == F.length("q2")) & (F.col("q1") < F.col("q2"))))
        pairs = pairs.unionByName(lone)
    near = pairs.withColumn("distance", F.levenshtein("q1", "q2", k)).where("distance >= 0")
    # Features of a sequence in lists: a pair of lists is one row until it is given
    # out, by as many tasks as are asked for and not as few as its bytes ask for.
    tasks = 4 * int(seq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = numbered(rows.where("feature is not null"), "n", "seq", "feature").groupBy("seq", F.expr(f"(n - 1) div {MEMBERS}").alias("part"))
    held = settled(lists.agg(F.collect_list("feature").alias("m")).select("seq", "part", "m"))
    one, two = (held.select(F.col("seq").alias(f"q{x}"), F.col("part").alias(f"p{x}"), F.col("m").alias(f"m{x}")) for x in (1, 2))
    wide = near.join(one, "q1").repartition(tasks, "q2").join(two, "q2")
    wide = wide.select(F.greatest(F.length("q1"), F.length("q2")).alias("n"), "distance", "m2", F.explode("m1").alias("a")).select("n", "distance", "a", F.explode("m2").alias("b"))
    wide = wide.select(F.least("a", "b").alias("f1"), F.greatest("a", "b").alias("f2"), "n", "distance")
    # Lists of a sequence are in order: pairs of two of them are, and of one half are.
    same = one.repartition(tasks, "q1").join(two.withColumnRenamed("q2", "q1"), "q1").where("p1 <= p2")
    same = same.select(F.length("q1").alias("n"), "m2", F.explode("m1").alias("f1")).select("n", "f1", F.explode("m2").alias("f2")).where("f1 < f2").select("f1", "f2", "n", F.lit(0).alias("distance"))
    return wide.unionByName(same).select("f1", "f2", "distance", F.coalesce(F.try_divide(F.col("distance"), F.col("n")), F.lit(0.0)).alias("normalized"))


def banded(one: list[str], two: list[str], band: int) -> np.ndarray:
    """Edits of alignments that keep within ``band`` of the diagonal (or within
    the difference of lengths), for many pairs at once: one cell of all pairs'
    tables is one operation on an array."""
    n, m = np.array([len(x) for x in one]), np.array([len(x) for x in two])
    if not len(n):
        return n
    rows, cols = int(n.max()), int(m.max())
    a, b = np.zeros((rows, len(n)), dtype=np.uint32), np.zeros((cols, len(n)), dtype=np.uint32)
    for k, (x, y) in enumerate(zip(one, two, strict=True)):
        a[: n[k], k] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        b[: m[k], k] = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = np.maximum(band, np.abs(n - m))
    far = np.int64(rows + cols + 1)
    wide = int(width.max())
    pick = np.arange(len(n))
    row = np.where(np.arange(cols + 1)[:, None] <= width, np.arange(cols + 1)[:, None], far)
    out = np.where(n == 0, row[m, pick], 0)
    for i in range(1, rows + 1):
        new = np.full_like(row, far)
        new[0] = np.where(i <= width, i, far)
        for j in range(max(1, i - wide), min(cols, i + wide) + 1):
            best = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            new[j] = np.where(abs(i - j) <= width, best, far)
        row = new
        out = np.where(n == i, row[m, pick], out)
    return out


def banded_column(one: Column | str, two: Column | str, band: int) -> Column:
    @F.pandas_udf("int")
    def edits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(banded(x.to_list(), y.to_list(), band), dtype="int32")

    return edits(one, two)
