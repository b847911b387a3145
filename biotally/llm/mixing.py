"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words by its weight; a target stops at
``max_epochs`` times the source's size and the excess goes to the others by
weight until none is above. Within a source, complete epochs come first; for
the rest of the target documents are taken in the order of exponential keys
``-ln(u) / weight`` until the words are used up, the last one in part. ``u``
hashes the id and the text (md5, which other engines have too), so that reruns
agree.

The order within a source is a sum over prefixes of sorted rows. To spread a
hot source, its rows go to ``BUCKETS`` parts by a monotone function of the key;
prefixes run within a part and over the sums of parts.

Defined cases: null texts have size 0, a null source is a source of its own
(last in order), documents of size 0 take 0, repeated rows are each a document,
an empty table gives an empty result, a total of 0 gives targets of 0. Other
columns are carried when ``keep`` names them. Columns only; no Python runs on
executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, let, row_order, whole_text

BUCKETS = 4096
MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 48 bits of the md5 of the parts joined by colons."""
    key = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("long") + F.lit(0.5).cast("double")) / F.lit(281474976710656.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1.25 by the share of letters and spaces in the text."""
    plain = F.length(F.regexp_replace(text, r"[\x00-\x1F\x21-\x40\x5B-\x60\x7B-\x7F]+", ""))
    return F.lit(0.25) + plain / F.greatest(F.length(text), F.lit(1))


def source_key(source: str) -> Column:
    """Null told apart from every string, sorted last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source key, source_size) -> with target.

    Sources reach their caps in the order of cap / weight, so the level at
    which the budget is spent follows from prefix sums over the sources, a
    table of a row for each.
    """
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy("_source")) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_weight")).withColumn("_total", F.sum("source_size").over(everything))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_weight = F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    df = df.withColumn("_level", (F.col("_total") - spent) / open_weight)
    # The first source, by ratio, whose cap is not reached at its level sets it.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_source", "_level"))).over(everything)["_level"]
    return df.withColumn("target", F.least(F.col("_cap"), F.col("_weight") * F.coalesce(level, F.col("_ratio")))).select("_source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, weight: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, text_key, source_key; text_key
    hashes the text, to join the documents again."""
    text = whole_text(text_col)
    u = uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text.cast("binary")))
    key = -F.ln(u) / (quality_weight(text) if weight is None else weight)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(source_col).alias("_source"), word_count(text).alias("size"), F.xxhash64(text).alias("text_key"), key.alias("_key"))
    # Few bytes a document; read three times below.
    rows = cut(rows.withColumn("_bucket", F.floor((F.lit(1.0) - F.exp(-F.col("_key") / 2)) * F.lit(BUCKETS)).cast("int")))
    buckets = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words"))
    prefix = F.sum("_words").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_words")
    goal = targets(buckets.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    plan = buckets.withColumn("_before", prefix).join(goal, "_source")
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = whole - epochs * F.col("source_size")
    start = F.col("_before") + F.sum("size").over(within) - F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return rows.join(plan, ["_source", "_bucket"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_key", F.col("_source").alias("source_key"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it was."""
    return let(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), lambda parts: F.array_join(F.slice(parts, 1, n.cast("int")), ""))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents as often as the mix takes them, a part last; columns as
    in ``docs``."""
    cols = docs.columns
    key, nth, m_id, m_key, m_nth, m_source, size, taken, copy, text = (fresh(docs, x) for x in ("mix_a", "mix_b", "mix_c", "mix_d", "mix_e", "mix_f", "mix_size", "mix_taken", "mix_copy", "mix_text"))
    # Rows with the same id, text and source are told apart by number on both sides.
    alike = Window.partitionBy("doc_id", "text_key", "source_key").orderBy(F.desc("taken"))
    copies = mixed.select(F.col("doc_id").alias(m_id), F.col("text_key").alias(m_key), F.col("source_key").alias(m_source), F.row_number().over(alike).alias(m_nth), F.col("size").alias(size), F.col("taken").alias(taken)).where(F.col(taken) > 0)
    rows = docs.withColumn(key, F.xxhash64(whole_text(text_col)))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(F.col(id_col).cast("long"), key, source_key(source_col)).orderBy(row_order(docs))))
    rows = rows.join(copies, F.col(id_col).cast("long").eqNullSafe(F.col(m_id)) & (F.col(key) == F.col(m_key)) & (source_key(source_col) == F.col(m_source)) & (F.col(nth) == F.col(m_nth)))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    rows = rows.withColumn(text, F.when(left >= F.col(size), F.col(text_col)).otherwise(first_words(whole_text(text_col), left)))
    swap = {text_col: F.col(text).alias(text_col)}
    if chars_col in cols:
        swap[chars_col] = F.length(text).cast("long").alias(chars_col)
    return rows.select(*[swap.get(c, F.col(f"`{c}`")) for c in cols])
