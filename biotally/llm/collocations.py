"""Phrase collocations by bucket counts (PCY/DHP) and Apriori pruning.

One pass over the texts for each length of phrase. The pass for length k counts
the phrases of k words that may be frequent, exactly, and at the same time the
phrases of k + 1 words in hashed buckets. A phrase may be frequent if its
bucket is, and if both phrases of one word less within it are: these are held
as bitmaps too, so that what is broadcast is bounded by ``MOST_BITS`` bits,
whatever the corpus. A bitmap has false members only, which cost time and never
a phrase: what counts as frequent is decided by exact counts, by the phrase
itself. In the same way a phrase of k + 1 words is put in a bucket only if both
phrases of k words within it may be frequent.

Bucket counters stop at 255 in a task, which leaves "at least ``least``" exact
for ``least`` up to 255 (above, every bucket counts as frequent). Tasks hand
them over in chunks, which are summed where they meet, one chunk at a time.

Scores and drops are joins by phrase. A phrase drops for a longer one that holds
it and is nearly as frequent. If the longer one has two words more, so does one
with a single word more, as that is at least as frequent as the longer one: only
neighbouring lengths are joined.

Defined cases: null texts are empty, a null language is ``und``; equal texts
count each; null, empty and very long texts are whole (a long one is cut
between pieces to be read in blocks); ids and other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove_folder, shared_folder, whole_text

LEAST, LONGEST, KEEP = 30, 4, 2000
#: Of a shorter phrase's occurrences so many percent in a longer one drop it.
WITHIN = 80
#: Bytes of text that a task reads into arrays at once.
BLOCK = 4 << 20
#: Buckets of a bitmap at most: 8 MB to broadcast, 64 MB of counters a task.
MOST_BITS = 26
#: Bytes of text for a bucket: some ten words, so that rare phrases alone do
#: not fill it.
BYTES = 64
CELLS = 1 << 13
#: Distinct phrases that a task holds before it hands their counts over.
HELD = 1 << 19

_LOWER = bytes(range(ord("a"), ord("z") + 1))
#: Letters are lower-cased, marks and line ends end a piece, a tab is a space.
FOLD = bytes.maketrans(_LOWER.upper() + b".,;:!?\n\x0b\x0c\r\t", _LOWER + b"\n" * 10 + b" ")

_COUNTED = "lang string, phrase string, n long, chunk int, cells binary"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of a phrase and one more word, from their hashes."""
    x = left * _MIX[0] + right
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    import zlib

    import xxhash

    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def pieces_of(low: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a folded text and the number of each one's piece."""
    raw = np.frombuffer(low, dtype=np.uint8)
    end = raw == 10
    gap = end | (raw == 32)
    starts = np.flatnonzero(np.concatenate([[True], gap[:-1]]) & ~gap)
    return low.split(), np.cumsum(end, dtype=np.int32)[starts]


def _blocks(texts: list[bytes]) -> Iterator[bytes]:
    """Folded texts, cut between pieces into parts of about ``BLOCK`` bytes."""
    low = b"\n".join(texts).translate(FOLD)
    at = 0
    while at < len(low):
        to = at + BLOCK
        if to < len(low):
            cut = low.rfind(b"\n", at, to)
            to = cut if cut > at else low.find(b"\n", to)
            to = len(low) if to < 0 else to
        yield low[at:to]
        at = to


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _distinct(ids: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and counts of equal tuples of word numbers below ``base``."""
    key, top = ids[0], base
    for column in ids[1:]:
        if top * base >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            top = len(key)
        key, top = key * base + column, top * base
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return first, counts


class _Pass:
    """What one task gathers: counts of phrases of ``k`` words, buckets of longer ones."""

    def __init__(self, k: int, buckets: int, may: np.ndarray | None, parts: np.ndarray | None):
        self.k, self.may, self.parts = k, may, parts
        self.counters = np.zeros(buckets, dtype=np.uint8)
        self.counts: dict[str, dict[bytes, int]] = defaultdict(dict)
        self.size = 0

    def read(self, lang: str, low: bytes) -> None:
        words, piece = pieces_of(low)
        k, n = self.k, len(words)
        if n < k:
            return
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
        single = _word_hashes(list(number), lang)[ids]
        shorter, hashes = None, single
        for j in range(2, k + 1):
            shorter, hashes = hashes, _joined(hashes[:-1], single[j - 1 :])
        whole = piece[: n - k + 1] == piece[k - 1 :]
        if k > 1:
            inside = _held(self.parts, shorter)
            whole = whole & inside[:-1] & inside[1:] & _held(self.may, hashes)
        at = np.flatnonzero(whole)
        if not len(at):
            return
        first, counts = _distinct([ids[at + j] for j in range(k)], len(number))
        kept = self.counts[lang]
        before = len(kept)
        for i, c in zip(at[first].tolist(), counts.tolist(), strict=True):
            phrase = words[i] if k == 1 else b" ".join(words[i : i + k])
            kept[phrase] = kept.get(phrase, 0) + c
        self.size += len(kept) - before
        if len(self.counters) and n > k:
            longer = np.flatnonzero(whole[:-1] & whole[1:] & (piece[: n - k] == piece[k:]))
            cells = _joined(hashes[longer], single[longer + k]) & np.uint64(len(self.counters) - 1)
            cells, times = np.unique(cells.astype(np.uint32), return_counts=True)
            self.counters[cells] = np.minimum(self.counters[cells] + times, 255)

    def phrases(self) -> Iterator[pa.RecordBatch]:
        for lang, kept in self.counts.items():
            names, counts = list(kept), list(kept.values())
            for i in range(0, len(names), 1 << 16):
                yield _batch(pa.array(names[i : i + (1 << 16)], pa.binary()).cast(pa.string()), counts[i : i + (1 << 16)], lang)
        self.counts.clear()
        self.size = 0


def _batch(phrases: pa.Array, counts: list[int], lang: str) -> pa.RecordBatch:
    n = len(counts)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n), phrases, pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["lang", "phrase", "n", "chunk", "cells"])


def _chunks(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The counters that are not all zero, ``CELLS`` a row."""
    table = counters.reshape(-1, min(CELLS, max(len(counters), 1)))
    rows = np.flatnonzero(table.any(axis=1))
    for i in range(0, len(rows), 256):
        part = rows[i : i + 256]
        m = len(part)
        cells = pa.array([table[r].tobytes() for r in part], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.array(part, pa.int32()), cells], names=["lang", "phrase", "n", "chunk", "cells"])


def _bits_for(n: float) -> int:
    """Buckets for ``n`` keys: a power of two, bounded by ``MOST_BITS``."""
    return 1 << min(MOST_BITS, max(13, int(n).bit_length()))


def _bitmap(parts: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the buckets whose counters add up to ``least``. At most
    2 ** ``MOST_BITS`` bits come to the driver."""
    spark = parts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets >> 22)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells"), strict=True):
                row = np.frombuffer(cells.as_buffer(), dtype=np.uint8)
                sums[chunk] = np.minimum(sums[chunk] + row, least).astype(np.uint16) if chunk in sums else np.minimum(row, least).astype(np.uint16)
        for chunk, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(row >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros(buckets // 8, dtype=np.uint8)
    width = min(CELLS, buckets) // 8
    for r in parts.where("chunk is not null").select("chunk", "cells").repartition(tasks, "chunk").mapInArrow(add, "chunk int, bits binary").collect():
        out[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _count(docs: DataFrame, k: int, buckets: int, may, parts) -> DataFrame:
    """One pass over the texts, as rows of ``_COUNTED``."""
    texts = docs.select("lang", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Pass(k, buckets, may and np.frombuffer(may.value, dtype=np.uint8), parts and np.frombuffer(parts.value, dtype=np.uint8))
        waiting: dict[str, list[bytes]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, held in waiting.items():
                for low in _blocks(held):
                    state.read(lang, low)
                    if state.size > HELD:
                        yield from state.phrases()
            waiting.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                waiting[lang].append(text)
                size += len(text)
                if size > 2 * BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()
        yield from state.phrases()
        yield from _chunks(state.counters)

    return texts.mapInArrow(run, _COUNTED)


def _marked(phrases: DataFrame, bits: int) -> DataFrame:
    """The buckets of whole phrases, as chunks of counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(bits, dtype=np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                hashes = _word_hashes(phrase.encode().split(b" "), lang)
                whole = hashes[:1]
                for j in range(1, len(hashes)):
                    whole = _joined(whole, hashes[j : j + 1])
                counters[int(whole[0]) & (bits - 1)] = 1
        yield from _chunks(counters)

    return phrases.select("lang", "phrase").mapInArrow(run, _COUNTED)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of the phrases of up to ``longest`` words that
    occur ``least`` times, and (lang, n), all words of each language. Both are
    written to the shared folder. ``buckets``: a power of two; by default it
    follows the size of the texts."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    if buckets is None:
        buckets = _bits_for((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / BYTES)
    may = parts = None
    totals = None
    tables = []
    for k in range(1, longest + 1):
        pass_at, kept_at = f"{folder}/pass{k}", f"{folder}/phrases{k}"
        _count(rows, k, buckets if k < longest else 0, may, parts).write.parquet(pass_at)
        counted = spark.read.schema(_COUNTED).parquet(pass_at)
        exact = counted.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if k == 1:
            # One task counts a language's words, from sums that come from every task.
            counted.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/totals")
            totals = spark.read.schema("lang string, n long").parquet(f"{folder}/totals")
        exact.where(F.col("a") >= least).withColumn("words", F.lit(k)).write.parquet(kept_at)
        table = spark.read.schema("lang string, phrase string, a long, words int").parquet(kept_at)
        tables.append(table)
        if k < longest:
            size = _bits_for(8 * table.count())
            for old in (may, parts):
                if old is not None:
                    old.destroy()
            may = spark.sparkContext.broadcast(_bitmap(counted, buckets, least).tobytes() if least <= 255 else b"\xff" * (buckets // 8))
            parts = spark.sparkContext.broadcast(_bitmap(_marked(table, size), size, 1).tobytes())
        remove_folder(spark, pass_at)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", *, least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, within: int = WITHIN, buckets: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``keep`` best
    phrases of 2 words or more. The score of a cut is floor(2000000 a / (l + r))
    and the lowest cut of a phrase counts."""
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least=least, longest=longest, buckets=buckets)
    longer = phrases.where("words > 1")
    words = F.split("phrase", " ", -1)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")

    cuts = longer.withColumn("w", words).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "words", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    counts = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    # Decimals: the product may pass 64 bits.
    score = F.expr("cast(2000000 as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "words").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = phrases.where("words > 2").withColumn("w", words).select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * within))
    left = left.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # A language's best of each part first, so that no task sorts a language.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("int")).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
