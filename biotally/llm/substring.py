"""Substring dedup by hashing lines, their sentences and runs of words.

A unit is a whole line of any length, a line's sentence (up to its mark, or the
line's end), a fragment of one (up to the next capitalised word), or a run of
the text's words, across lines, between two cuts. The latter two begin and end
where the passage itself says, so that one pasted into a text has units of its
own. A cut follows the pair of words with the least hash of some ``WINDOW``
pairs in a row, and runs overlap until each has ``LEAST`` words: equal passages
of 2 ``WINDOW`` + ``LEAST`` words or more always share a unit, and all between
their first and their last common cut is in units. White
space is squeezed, letters are lower-cased
and 128 bits of the rest are grouped over the whole corpus. Of equal units the
earliest, by id and offset, stays; the rest go, with their original offsets
kept. Other units than lines need ``LEAST`` words.

Only digests are shuffled, not texts. Repeats within a document are settled
where it is read; counts are combined before the shuffle, and occurrences meet
the first one in an equality join that Spark can split where a unit is frequent.

Defined cases: null texts are empty and have no units; rows that share id and
text are one document; a null id ranks last; an empty table gives an empty
result; other columns are carried by ``without_repeats`` alone.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, key_set, maybe_in, process_store, set_size, whole_text

#: Words that a unit needs to be judged, unless it is a line.
LEAST = 8
#: Of so many pairs of words in a row one at least is a cut.
WINDOW = 16
#: Texts are cut into units together, up to so many code points.
BLOCK = 1 << 20


def _marks(pattern: str) -> np.ndarray:
    """Whether each code point matches; made once a worker process."""
    store = process_store()
    if ("marks", pattern) not in store:
        out = np.zeros(sys.maxunicode + 1, dtype=bool)
        out[[m.start() for m in re.finditer(pattern, "".join(map(chr, range(sys.maxunicode + 1))))]] = True
        store["marks", pattern] = out
    return store["marks", pattern]


def _changes(x: np.ndarray) -> np.ndarray:
    """Whether each element differs from the one before; the first does."""
    return np.concatenate([np.ones(min(len(x), 1), dtype=bool), x[1:] != x[:-1]])


def _cuts(raw: list[bytes], doc: np.ndarray) -> np.ndarray:
    """Word numbers behind the least pair of each window within a document."""
    if len(raw) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, raw[1:], map(zlib.crc32, raw)), dtype=np.uint64, count=len(raw) - 1)
    low, wide = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), 1  # equal pairs: the first
    while wide < WINDOW:
        step = min(wide, WINDOW - wide)
        low, wide = np.minimum(low[:-step], low[step:]), wide + step
    least = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[doc[:-WINDOW] == doc[WINDOW:]]
    return least[_changes(least)] + 2


def _runs(raw: list[bytes], doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a document's words between cuts, each as short as ``least``
    allows from its start or from its end."""
    first = np.flatnonzero(_changes(doc))
    last = np.append(first[1:], len(doc))
    cuts = _cuts(raw, doc)
    inner = cuts[cuts < last[np.searchsorted(first, cuts - 1, "right") - 1]]
    # By document, so that one's end comes before the next one's start.
    edges, owner = np.concatenate([first, inner, last]), np.concatenate([doc[first], doc[inner], doc[first]])
    order = np.lexsort((edges, owner))
    edges, owner = edges[order], owner[order]
    ahead = np.searchsorted(edges, edges + least, "left")
    back = np.searchsorted(edges, edges - least, "right") - 1
    here = np.arange(len(edges))
    pairs = []
    for a, b in ((here, ahead), (back, here)):
        ok = (a >= 0) & (b < len(edges))
        a, b = a[ok], b[ok]
        same = owner[a] == owner[b]
        pairs.append((edges[a[same]], edges[b[same]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((b, a))
    return a[order], b[order]


def _spans(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(new))


def block_units(texts: list[str], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """document (place in ``texts``), start, end, words and normalised bytes of
    each unit: of each document, first its runs, then its lines, then sentences,
    each before its fragments. Every unit is a run of whole words, listed once.

    All are found on arrays of the block's words: Python touches a word where it
    is lower-cased and hashed, and a unit where its bytes are taken."""
    whole = "\n".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    edge = np.flatnonzero(np.diff(_marks(r"\S")[points], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(offset, starts, "right") - 1
    if not len(starts):
        return doc, starts, ends, starts, []
    low = " ".join(whole.split()).lower().encode("utf-8", "surrogatepass")
    raw = low.split(b" ")
    line = _changes(np.searchsorted(np.flatnonzero(points == 10), starts))
    sentence = line | np.append(True, np.isin(points[ends[:-1] - 1], [ord(c) for c in ".!?"]))
    fragment = sentence | _marks(r"[^\W\d_a-zß-öø-ÿ]")[points[starts]]

    lines, sentences, fragments = _spans(line), _spans(sentence), _spans(fragment)
    a, b = (np.concatenate(x) for x in zip(sentences, fragments, strict=True))
    order = np.argsort(a, kind="stable")
    order = order[b[order] - a[order] >= least]
    a, b = (np.concatenate(x) for x in zip(_runs(raw, doc, least), lines, (a[order], b[order]), strict=True))
    once = np.sort(np.unique(a * (len(raw) + 1) + b, return_index=True)[1])
    a, b = a[once], b[once]

    gaps = np.flatnonzero(np.frombuffer(low, dtype=np.uint8) == 32)
    at = np.concatenate([[0], gaps + 1, [len(low) + 1]])
    taken = [low[i:j] for i, j in zip(at[a].tolist(), (at[b] - 1).tolist(), strict=True)]
    home = doc[a]
    return home, starts[a] - offset[home], ends[b - 1] - offset[home], b - a, taken


def text_units(text: str, least: int = LEAST) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised) of each unit of one text."""
    _, starts, ends, words, taken = block_units([text], least)
    for start, end, n, unit in zip(starts.tolist(), ends.tolist(), words.tolist(), taken, strict=True):
        yield start, end, n, unit.decode("utf-8", "surrogatepass")


def _blocks(texts: list[str]) -> Iterator[slice]:
    """Texts that follow one another, of ``BLOCK`` code points or one text."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > BLOCK:
            yield slice(first, k)
            first, size = k, 0
        size += len(text) + 1
    if first < len(texts):
        yield slice(first, len(texts))


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST) -> DataFrame:
    """doc_id, text_key, start, end, words, hi, lo (the digest), again (the
    offset of the unit's first occurrence in the same document, else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for block in _blocks(texts):
                home, starts, ends, words, taken = block_units(texts[block], least)
                digests = list(map(xxhash.xxh3_128_digest, taken))
                seen: dict[tuple[int, bytes], int] = {}
                first = np.fromiter(map(seen.setdefault, zip(home.tolist(), digests, strict=True), starts.tolist()), dtype=np.int64, count=len(digests))
                halves = (np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                rows = pa.array(home + block.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(starts), pa.array(ends), pa.array(words.astype(np.int32)), pa.array(halves[::2]), pa.array(halves[1::2]), pa.array(first, mask=first == starts)],
                    names=["doc_id", "text_key", "start", "end", "words", "hi", "lo", "again"],
                )

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, start long, end long, words int, hi long, lo long, again long")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST) -> DataFrame:
    """Passages to remove: doc_id, text_key, start, end (code points, end
    exclusive), n_units, first_doc_ids (the ids that keep a unit of it) and
    first_doc_id, the smallest. Units that overlap or touch but for white space
    are one passage."""
    found = units(docs, id_col, text_col, least=least)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_key"))
    fresh_units = found.where("again is null")
    # Written out, so that the join below has an exchange on either side and a
    # frequent unit's occurrences can be split over tasks.
    firsts = cut(fresh_units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("latest")).where("first <> latest").select("hi", "lo", "first"))
    first = F.col("first")
    # Units that surely occur once are not shuffled to find that out.
    bits = set_size(firsts.count())
    found = maybe_in(found, key_set(firsts, "hi", "lo", bits=bits), "maybe", "hi", "lo", bits=bits).where("maybe or again is not null").drop("maybe")
    gone = found.join(firsts, ["hi", "lo"], "left").where(F.col("again").isNotNull() | (first.isNotNull() & (first != rank)))
    gone = gone.select("doc_id", "text_key", "start", "end", F.when(first.isNotNull(), first["doc_id"]).otherwise(F.col("doc_id")).alias("first_doc_id")).dropDuplicates(["doc_id", "text_key", "start", "end"])
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = gone.withColumn("new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("doc_id", "text_key", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.min("first_doc_id").alias("first_doc_id"), F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids")).drop("passage")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: int = LEAST) -> DataFrame:
    """The documents without the passages to remove, which a further column
    ``removed`` lists with their original offsets."""
    i, k, removed = fresh(docs, "repeat_id"), fresh(docs, "repeat_key"), fresh(docs, "removed").lstrip("_") or "removed"
    spans = repeats(docs, id_col, text_col, least=least).groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(k)).agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias(removed))
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(whole_text(text_col)) == F.col(k)), "left")

    @F.pandas_udf("string")
    def kept(texts: pd.Series, ends: pd.Series) -> pd.Series:
        def one(text: str | None, cuts) -> str | None:
            if text is None or cuts is None:
                return text
            parts, at = [], 0
            for a, b in cuts:
                parts.append(text[at:a])
                at = b
            return "".join([*parts, text[at:]])

        return pd.Series([one(t, c) for t, c in zip(texts, ends, strict=True)], dtype=object)

    cuts = F.transform(removed, lambda s: F.array(s["start"], s["end"]))
    return joined.select(*[kept(F.col(text_col), cuts).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.col(removed))
