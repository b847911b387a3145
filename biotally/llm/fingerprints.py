"""Document fingerprints from closed syncmers, in columns only.

A text is read as words. Of every five in a row (a k-mer) the four pairs inside
are hashed; the k-mer is a closed syncmer, and an anchor, when the first or the
last pair has the smallest hash. Whether a k-mer is chosen depends on nothing
around it, so equal passages have equal anchors wherever they stand. Texts of
fewer words than a k-mer have themselves as the only anchor.

A fingerprint holds every anchor in the order of the text: its place (the number
of the k-mer's first word, from 0) and its hash, in hexadecimal; likeness is the
Jaccard index of two texts' distinct anchors, all of them.

Defined cases: null texts are empty, with the empty fingerprint, which is like
itself (1) and unlike any other (0); equal texts have equal fingerprints;
repeated ids are ordered by their texts' hash and then by the text, null ids
come last in the same way; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, whole_text

K, S = 5, 2
#: Ranges that the documents' order is cut into at most, and rows of one, about.
RANGES = 65_536
RANGE_ROWS = 1000


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def placed(text: Column) -> Column:
    """The closed syncmers in order: their places, from 0, and their hashes."""

    def chosen(h: Column) -> Column:
        def of_pairs(p: Column) -> Column:
            last = F.size(p) - (K - S)
            starts = F.filter(F.sequence(F.lit(1), last), lambda i: F.least(F.get(p, i - 1), F.get(p, i + 2)) <= F.least(F.get(p, i), F.get(p, i + 1)))
            return let(starts, lambda at: F.struct(F.transform(at, lambda i: i - 1).alias("places"), F.transform(at, lambda i: F.xxhash64(F.get(p, i - 1), F.get(p, i + 1), F.get(h, i + 3))).alias("hashes")))

        pairs = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda a, b: F.xxhash64(a, b))
        alone = F.struct(F.array(F.lit(0)).alias("places"), F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " "))).alias("hashes"))
        none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("hashes"))
        return F.when(F.size(h) >= K, let(pairs, of_pairs)).when(F.size(h) > 0, alone).otherwise(none)

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), chosen)


def anchors(text: Column) -> Column:
    """Hashes of the closed syncmers, in order of their place."""
    return placed(text)["hashes"]


def listed(anchors: Column) -> Column:
    """Every anchor as place:hash, with spaces between."""
    return F.array_join(F.zip_with(anchors["places"], anchors["hashes"], lambda p, x: F.concat(F.lower(F.hex(p)), F.lit(":"), F.lpad(F.lower(F.hex(x)), 16, "0"))), " ")


def alike(a: Column, b: Column) -> Column:
    """Jaccard of all distinct hashes; 1 if both are empty."""

    def of(both: Column) -> Column:
        return both.cast("double") / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both)

    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(let(F.size(F.array_intersect(a, b)), of))


def fingerprint(text: Column) -> Column:
    return listed(placed(text))


def _constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x: {schema}>")["x"]


def slots(docs: DataFrame, wanted: int) -> Column:
    """The part of the order (ids descending, null last, equal ids by ``tie``)
    that a row (doc_id, tie) is in, as a number that ascends with the order."""
    facts = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.percentile_approx("doc_id", [k / max(2, wanted) for k in range(1, max(2, wanted))], 20 * wanted).alias("cuts")).first()
    parts: dict[int, int] = {}
    for c in facts["cuts"] or []:
        parts[c] = parts.get(c, 0) + 1
    # An id that is several quantiles has a range of its own, cut by the tie.
    cuts = sorted({*parts, *(c - 1 for c, m in parts.items() if m > 1)})
    split = [parts.get(c, 1) for c in cuts] + [1]
    of_null = max(1, -(-(facts["n"] - facts["ids"]) * wanted // max(1, facts["n"])))
    # Two looks at some 256 cuts each, not one at all.
    width = max(1, math.isqrt(max(1, len(cuts))))
    rows = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    row = below(_constant([r[-1] for r in rows], "array<bigint>"))
    at = let(row, lambda k: F.least(F.lit(len(cuts)), k * F.lit(width) + F.coalesce(below(F.get(_constant(rows, "array<array<bigint>>"), k)), F.lit(0)))) if cuts else F.lit(0)
    share = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)
    inner = let(at, lambda k: F.struct((F.lit(len(cuts)) - k).cast("long").alias("from_top"), F.get(_constant(split, "array<int>"), k).alias("split")))
    of_id = let(inner, lambda x: x["from_top"] * F.lit(1 << 20) + F.floor(share * x["split"]))
    return F.when(F.col("doc_id").isNull(), F.lit((len(cuts) + 1) * (1 << 20)) + F.floor(share * F.lit(of_null))).otherwise(of_id).cast("long")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text, and the anchors of both (the next one's without
    places): the next document is the one with the next smaller id, and the
    first one after the last.

    The order is cut into slots at quantiles. A slot's texts meet in one task;
    what follows a slot's last document is the first of the next slot, which
    is read apart, one document a slot.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    wanted = int(min(RANGES, max(1, rows.count() // RANGE_ROWS)))
    rows = rows.withColumn("slot", slots(rows, wanted))
    # At most a row for each slot, whose number is bounded. ~id turns the order of ids round.
    first = rows.groupBy("slot").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("back"), F.col("tie"))).alias("head"))
    heads = sorted(first.select("slot", "head.back", "head.tie").collect(), key=lambda r: r["slot"])
    follows = [(heads[k - 1]["slot"], None if r["back"] is None else ~r["back"], r["tie"]) for k, r in enumerate(heads)]
    small = docs.sparkSession.createDataFrame(follows, "after long, head long, head_tie long")
    picked = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie")))
    picked = picked.groupBy(F.col("after").alias("slot")).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(picked.withColumn("guest", F.lit(1)))
    both = both.repartition("slot").withColumn("anchors", placed(F.col("text")))  # texts move without their anchors
    order = Window.partitionBy("slot").orderBy("guest", F.desc_nulls_last("doc_id"), "tie", "text")
    both = both.withColumns({"next_text": F.lead("text").over(order), "next_anchors": F.lead("anchors.hashes").over(order)})
    return both.where("guest = 0").select("doc_id", "text", "anchors", "next_text", "next_anchors")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many, or all,
    of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each document."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint(whole_text(text_col)).alias("fingerprint"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited_text, the anchors of both and of the next text."""
    rows = with_next(docs, id_col, text_col).withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).withColumn("edited_anchors", placed(F.col("edited_text")))
    return rows.select("doc_id", "text", "edited_text", "anchors", "edited_anchors", "next_anchors")
