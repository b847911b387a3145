"""SimHash near-duplicates with deletion-variant signatures.

A document's fingerprint has a bit for each bit set in over half of its
shingles' XXH64. Fingerprints that differ in at most three of 64 bits link.
Cut in two halves, one half of such a pair differs in one bit at most; so each
distinct fingerprint is indexed under each half with each bit left out in turn
(64 keys), pairs that share a key meet by equality and are verified.

Equal fingerprints are one node, so copies cost nothing. Within a key, links
are found on sorted arrays and a spanning forest of them leaves the task, at
most a row for each fingerprint; runs too long for comparing all pairs are
indexed once more on the other half, which is exact too.

``near_copies`` links documents whose sets of five-word shingles have a Jaccard
index of 0.8 or more. Such texts have most of their words in common, so a longer
SimHash of the distinct words is the index: ``SEGMENTS`` segments of 32 bits,
each indexed without each run of ``WILDCARD`` bits in turn. Documents that share
a key are candidates, and every candidate pair is verified by the whole sets of
shingles, so each link is a true one. Of true pairs the index finds what differs
in one place of one segment at least: with p the share of bits that differ (0.06
on average, 0.105 at most among the test tables' pairs at 0.8 to 0.94), one
segment does so with (1-p)^32 + 8 (1-p)^28 (1 - (1-p)^4), which leaves 0.9999 and
0.97 of the pairs. Texts of equal sets are one node. Of those that share a key,
none stays that differs from all others in over ``CHECK_BITS`` of 64 further
bits (of unrelated texts 1 in 200 does not). What candidates connect is a group,
and a group's sets are sent to one task, once; groups too large for that are
taken apart by their keys, and keys with too many texts for one task are
compared in blocks of bounded size, block by block.

Defined cases: null and empty texts have fingerprint 0 and link like any other;
texts of fewer words than a shingle hash as a whole; repeated rows and ids share
their fingerprint's component; an empty table gives an empty result. Of a group
the row with the smallest id stays (null last; among texts that share it, by
their hash), once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, key_set, maybe_in, row_order, whole_text

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Runs of one key up to this length are compared as they are; longer ones are indexed again.
RUN = 16_384


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space alone


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = _words(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), dtype="<u8", count=len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (the text's hash), fp (the fingerprint's 64 bits as a
    signed long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).astype(np.int64))

    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), fp(text).alias("fp"))


# -- links under one key ------------------------------------------------------


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a spanning forest among n nodes."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(k)
    return a[keep], b[keep]


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= DISTANCE


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], dtype=int)
    return at, np.diff(np.r_[at, len(keys)])


def _grown(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among distinct fingerprints: each tree grows from
    its first node, comparing what it reached with what none has reached."""
    left, right = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    unseen = np.arange(len(fps))
    while len(unseen):
        queue, unseen = [int(unseen[0])], unseen[1:]
        while queue and len(unseen):
            x = queue.pop()
            hit = _close(fps[x], fps[unseen])
            if hit.any():
                new = unseen[hit]
                unseen = unseen[~hit]
                left.append(np.full(len(new), x))
                right.append(new)
                queue += new.tolist()
    return np.concatenate(left), np.concatenate(right)


def links_in_run(fps: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among fingerprints that agree in a half but for one
    bit. ``half`` (0 low, 1 high) is the half that agrees."""
    n = len(fps)
    if n <= RUN:
        return _grown(fps)
    # The other half differs by three bits at most: one of its quarters by one at most.
    other = (fps >> np.uint64(0 if half else 32)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    left, right = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
    for quarter in (0, 16):
        part = (other >> np.uint64(quarter)) & np.uint64(0xFFFF)
        for bit in range(16):
            key = part & ~np.uint64(1 << bit)
            order = np.argsort(key, kind="stable")
            starts, lengths = _runs(key[order])
            for s, m in zip(starts[lengths > 1].tolist(), lengths[lengths > 1].tolist(), strict=True):
                own = order[s : s + m]
                a, b = _grown(fps[own])
                left, right = np.r_[left, own[a]], np.r_[right, own[b]]
            left, right = _forest(n, left, right)
    return left, right


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links (a, b)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def judged(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = _runs(keys)
        out_a, out_b = [], []
        two = starts[lengths == 2]  # most runs, taken together
        ok = _close(fps[two], fps[two + 1])
        out_a.append(fps[two][ok])
        out_b.append(fps[two + 1][ok])
        for s, m in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
            run = fps[s : s + m]
            a, b = links_in_run(run, int(keys[s] >> 37))
            out_a.append(run[a])
            out_b.append(run[b])
        return np.concatenate(out_a), np.concatenate(out_b)

    def batch(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        a, b = (x.view(np.int64) for x in pair)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for rb in batches:
        keys = rb.column(0).to_numpy(zero_copy_only=False)
        fps = rb.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if not len(keys):
            continue
        if held and held[0][0][0] == keys[-1]:  # one key still: nothing to join yet
            held.append((keys, fps))
            continue
        held.append((keys, fps))
        keys, fps = (np.concatenate(c) for c in zip(*held, strict=True))
        last = int(_runs(keys)[0][-1])
        held = [(keys[last:], fps[last:])]
        if last:
            yield batch(judged(keys[:last], fps[:last]))
    if held:
        yield batch(judged(*(np.concatenate(c) for c in zip(*held, strict=True))))


def signatures(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints -> (key, fp), 64 rows each. A key holds the number
    of the bit left out and the half that bit is in, without it."""
    half = F.when(F.col("k") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    rest = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, k % 32)")))
    return rows.select(F.expr("shiftleft(cast(k as bigint), 32)").bitwiseOR(rest).alias("key"), "fp")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints -> links (a, b) that connect what links of at most
    three bits connect."""
    keyed = signatures(fps).repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(_links, "a long, b long").distinct()


# -- components ---------------------------------------------------------------


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Links (a, b) -> (node, root) of every node but the roots, by alternating
    large and small stars.

    Each round links a node's larger neighbours, then its smaller ones, to the
    smallest; the links end as stars around the smallest node of a component.
    """
    stars = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        stars = cut(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_key, fp), and fingerprints (fp, first, kept, root):
    the smallest id that has one, the row of it that would stay, its component."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle=shingle))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(row).alias("kept")))
    roots = components(fingerprint_links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    return rows, nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id; one row a document."""
    rows, named = _named(docs, id_col, text_col, shingle)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def _kept_rows(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``firsts`` (kept: last, doc_id, text_key) names, each once."""
    cols, i, k, nth = docs.columns, fresh(docs, "first_id"), fresh(docs, "first_key"), fresh(docs, "nth")
    firsts = firsts.select(F.col("kept.doc_id").alias(i), F.col("kept.text_key").alias(k))
    key = F.xxhash64(whole_text(text_col))
    kept = docs.join(firsts, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (key == F.col(k)), "left_semi")
    within = Window.partitionBy(F.col(id_col).cast("long"), key).orderBy(row_order(docs))
    return kept.withColumn(nth, F.row_number().over(within)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in cols])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component of fingerprints."""
    _, named = _named(docs, id_col, text_col, shingle)
    return _kept_rows(docs, named.groupBy("root").agg(F.min("kept").alias("kept")), id_col, text_col)


# -- near-copies at a similarity -----------------------------------------------

NEAR_SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS, WILDCARD = 20, 4
#: Candidates differ in at most so many of 64 bits beside the segments.
CHECK_BITS = 20
#: Shingles of a group or block of texts, about.
BLOCK_SHINGLES = 2_000_000
#: Nodes of a run that are held to see whether other keys give the same run.
HELD = 65_536
_LANES = np.arange(1, SEGMENTS // 2 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[bytes], shingle: int = NEAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of the words' shingles, ascending."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(s)) for s in zip(*(words[k:] for k in range(shingle)), strict=False)), dtype=np.uint64))


def segments(words: list[bytes]) -> np.ndarray:
    """The segments of a SimHash of the distinct words, 32 bits each, and two
    more to check by."""
    import xxhash

    own = set(words)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), dtype=np.uint64, count=len(own))
    ones = np.zeros(32 * SEGMENTS + 64, dtype=np.int64)
    for lo in range(0, len(h), 2048):
        x = h[lo : lo + 2048, None] + _LANES
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u4").astype(np.int64)


def similar_links(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A forest of the links among sets, each tree grown from its first one:
    what no tree has reached is compared with what this one has, all at once."""
    left, right = [], []
    size = np.array([len(s) for s in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    own = np.zeros(len(distinct), dtype=bool)
    unseen, rest, at = np.arange(len(sets)), flat, starts  # their elements, and where each one's begin
    alive = np.ones(len(unseen), dtype=bool)

    def first() -> int | None:
        k = int(alive.argmax()) if len(alive) else 0
        return k if len(alive) and alive[k] else None

    while (k := first()) is not None:
        alive[k] = False
        queue = [int(unseen[k])]
        while queue and alive.any():
            x = queue.pop()
            if 2 * alive.sum() < len(alive):  # leave out what was reached
                rest = np.concatenate([flat[starts[y] : starts[y] + size[y]] for y in unseen[alive]])
                unseen = unseen[alive]
                alive = np.ones(len(unseen), dtype=bool)
                at = np.cumsum(size[unseen]) - size[unseen]
            mine = flat[starts[x] : starts[x] + size[x]]
            own[mine] = True
            both = np.add.reduceat(own[rest], at, dtype=np.int64)
            own[mine] = False
            hit = alive & (both >= similarity * (size[unseen] + size[x] - both))
            new = unseen[hit].tolist()
            alive[hit] = False
            left += [x] * len(new)
            right += new
            queue += new
    return left, right


def wildcard_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, check): each segment without each run of bits in turn."""
    parts = 32 // WILDCARD
    own = nodes.select("node", "check", F.posexplode("segments").alias("s", "bits")).select("node", "check", "s", "bits", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g"))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.expr(f"shiftleft({(1 << WILDCARD) - 1}L, g * {WILDCARD})")))
    return own.select(F.expr(f"shiftleft(cast(s * {parts} + g as bigint), 32)").bitwiseOR(rest).alias("key"), "node", "check")


def _checked(check: np.ndarray) -> np.ndarray:
    """Which of a run's nodes have another that the check lets through."""
    if len(check) > 256:  # most near-copies of each other; their sets will tell
        return np.ones(len(check), dtype=bool)
    near = np.bitwise_count(check[:, None] ^ check[None, :]) <= CHECK_BITS
    return near.sum(axis=1) > 1


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, check) sorted -> (run, least, node) of runs of two nodes
    and more; the same nodes under several keys are the same run."""
    import xxhash

    held: list[tuple[np.ndarray, np.ndarray]] = []
    key, least, kept, streaming = None, 0, 0, False

    def rows(runs: list, leasts: list, nodes: list) -> pa.RecordBatch:
        many = [len(x) for x in nodes]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(runs, dtype=np.int64), many)), pa.array(np.repeat(np.array(leasts, dtype=np.int64), many)), pa.array(np.concatenate(nodes), pa.int64())], names=["run", "least", "node"])

    def close(out: tuple[list, list, list]) -> None:
        if kept > 1 and not streaming:
            nodes, check = (np.concatenate(c) for c in zip(*held, strict=True))
            nodes = nodes[_checked(check)]
            if len(nodes) > 1:
                add(out, xxhash.xxh64_intdigest(nodes.tobytes()), int(nodes[0]), nodes)

    def add(out: tuple[list, list, list], run: int, first: int, nodes: np.ndarray) -> None:
        for column, value in zip(out, (run - (1 << 63), first, nodes), strict=True):
            column.append(value)

    for rb in batches:
        keys, nodes, checks = (rb.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        out: tuple[list, list, list] = ([], [], [])
        starts, lengths = _runs(keys)
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            if m == 1 and s + 1 < len(keys) and keys[s] != key:  # alone, and surely ended
                close(out)
                key, held, kept, streaming = keys[s], [], 0, False
                continue
            if keys[s] != key:
                close(out)
                key, held, kept, streaming, least = keys[s], [], 0, False, int(nodes[s])
            held.append((nodes[s : s + m], checks[s : s + m].view(np.uint64)))
            kept += m
            if streaming or kept > HELD:  # too long to hold: a run of its own
                add(out, xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True)), least, np.concatenate([x for x, _ in held]))
                held, streaming = [], True
        if out[0]:
            yield rows(*out)
    last: tuple[list, list, list] = ([], [], [])
    close(last)
    if last[0]:
        yield rows(*last)


def _cells(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (run, least, node) -> (cell, node): nodes of a cell are
    compared, and any two that share a run share a cell."""
    groups = components(met.select(F.col("least").alias("a"), F.col("node").alias("b")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    groups = groups.join(nodes.select("node", "size"), "node")
    total = groups.groupBy("root").agg(F.sum("size").alias("n"))
    groups = cut(groups.join(total, "root").select("node", "root", "size", (F.col("n") > BLOCK_SHINGLES).alias("large")))
    small = groups.where("not large").select(F.xxhash64("root").alias("cell"), "node")
    sized = met.select("run", "node").join(groups.where("large").select("node", "size"), "node")
    runs = sized.groupBy("run").agg(F.sum("size").alias("n")).select("run", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = sized.join(runs, "run").select("run", "node", block.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return small.unionByName(cells.select(F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node"))


def _verified(met: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Candidates (run, least, node) -> links (a, b) of at least the similarity."""
    cells = cut(_cells(met, nodes))
    wanted = nodes.join(cells.select("node").distinct(), "node", "left_semi").select("node", F.col("kept.doc_id").alias("i"), F.col("kept.text_key").alias("k"))

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(_words(t), shingle).tobytes() for t in text], dtype=object)

    # Texts that are surely no candidates are not shuffled.
    near = maybe_in(texts, key_set(wanted, "k"), "maybe", "text_key").where("maybe")
    sets = near.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["node"]).select("node", packed("text").alias("set"))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held, own = None, [], []

        def out() -> pd.DataFrame:
            a, b = similar_links(own, similarity)
            at = np.array(held, dtype=np.int64)
            return pd.DataFrame({"a": at[a], "b": at[b]})

        for pdf in batches:
            for c, node, raw in zip(pdf["cell"].tolist(), pdf["node"].tolist(), pdf["set"].tolist(), strict=True):
                if c != cell:
                    if len(held) > 1:
                        yield out()
                    cell, held, own = c, [], []
                held.append(node)
                own.append(np.frombuffer(raw, dtype=np.uint64))
        if len(held) > 1:
            yield out()

    return cells.join(sets, "node").repartition("cell").sortWithinPartitions("cell", "node").mapInPandas(judged, "a long, b long").distinct()


def _near(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text_key, node), and nodes (node, first, kept, root)."""

    @F.pandas_udf("node long, size int, check long, segments array<long>")
    def signed(text: pd.Series) -> pd.DataFrame:
        import xxhash

        node, size, segs = [], [], []
        for t in text:
            w = _words(t)
            h = shingles(w, shingle)
            node.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
            size.append(len(h))
            segs.append(segments(w))
        check = [int(x[-2]) | int(x[-1]) << 32 for x in segs]
        return pd.DataFrame({"node": node, "size": size, "check": np.array(check, dtype=np.uint64).astype(np.int64), "segments": [x[:-2] for x in segs]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(whole_text(text_col)).alias("text_key"), whole_text(text_col).alias("text"))
    rows = cut(texts.select("doc_id", "text_key", signed("text").alias("s")).select("doc_id", "text_key", "s.node", "s.size", "s.check", "s.segments"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(row).alias("kept"), F.min("size").alias("size"), F.min("check").alias("check"), F.min("segments").alias("segments")))
    # A set of fewer elements than this is similar to itself alone.
    indexed = nodes.where(F.col("size") >= similarity / (1 - similarity) - 1e-9) if similarity < 1 else nodes.limit(0)
    met = cut(wildcard_keys(indexed).repartition("key").sortWithinPartitions("key", "node").mapInArrow(_met, "run long, least long, node long").distinct())
    roots = components(_verified(met, nodes, texts, shingle, similarity))
    return rows.select("doc_id", "text_key", "node"), nodes.select("node", "first", "kept").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id; one row a document."""
    rows, named = _near(docs, id_col, text_col, shingle, similarity)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.select("node", "root").join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-copies."""
    _, named = _near(docs, id_col, text_col, shingle, similarity)
    return _kept_rows(docs, named.groupBy("root").agg(F.min("kept").alias("kept")), id_col, text_col)
