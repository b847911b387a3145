"""Best-fit packing of tokenised documents by bin completion.

The packing problem depends only on how many pieces there are of each length,
and lengths are at most ``capacity``. So the driver solves the histogram (at
most ``capacity`` rows, whatever the corpus holds) and the cluster maps each
piece to its place by its length and its rank among pieces of that length.

The solver is bin completion: take the largest piece that is left, enumerate
the undominated fillings of the room beside it, branch on them best first,
prune by the waste that a better packing could still afford, and start from
best-fit decreasing as incumbent. ``Limits`` bounds the search, which then may
end above the least number of sequences; the result says what it reached
(``sequences``) and a bound that no packing passes (``sequences_bound``). With
``EXACT`` the search has no limit and its result is the least number.

Defined cases: null and empty texts give one piece that holds the end id alone;
repeated rows and repeated ids are packed like any other rows; an empty table
gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, process_store, whole_text

CAPACITY = 4096
END_ID = 1
#: Parts that the pieces of one length are ranked in, at least, and pieces for each more.
SALTS = 256
SALT_ROWS = 1_000_000


@dataclass(frozen=True)
class Limits:
    """What the search spends; None is no limit."""

    #: Branch-and-bound steps after which the incumbent is kept.
    nodes: int | None = 8_000
    #: Fillings that a step branches on.
    width: int | None = 4
    #: Steps of one enumeration of fillings, and lengths tried at each.
    effort: int | None = 400
    children: int | None = 12
    #: Branch on every bin for itself, not on a filling as often as counts allow.
    one_by_one: bool = False


LIMITED = Limits()
#: Ends with the least number of bins, however long that takes.
EXACT = Limits(None, None, None, None, one_by_one=True)
TOKENIZER = "word_bpe_49k.json"
#: Text that is encoded at once, about; its ids take some ten times as much memory.
BATCH_BYTES = 8_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts.

    The tokenizer's pre-tokens never span white space, nor a place where marks
    follow a letter or digit, so the ids of a text are those of its words in
    turn, and a word's those of its letters and of the marks behind them. What
    was encoded is kept, up to ``keep`` entries, after which the store starts
    afresh. The tokenizer lower-cases; words are kept lower-cased unless the
    text could hold a special token.
    """

    def __init__(self, path: str, keep: int = 600_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        self.known: dict[bytes, bytes] = {b"": b""}
        last = [token.endswith("</w>") for token, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends_word = np.array(last, dtype=bool)

    def _one_by_one(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 4096):
            part = words[lo : lo + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.known.update(zip(part, (np.asarray(e.ids, dtype="<u4").tobytes() for e in found), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Words of letters alone are one pre-token each: many are encoded as one
        text and told apart by the tokens that end a word."""
        plain, others = [], []
        for w in words:
            (plain if w.isalpha() or w.decode("utf-8", "replace").isalpha() else others).append(w)
        for lo in range(0, len(plain), 64):
            part = plain[lo : lo + 64]
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):  # letters to Python, not to the tokenizer
                self._one_by_one(part)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends], ends, strict=False))
        self._one_by_one(others)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts -> all their ids in one array, and each text's end in it.

        Arrow splits and numbers the words, so that each distinct word of a
        batch is looked up once; numpy lays the ids of the words end to end.
        """
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.ascii_split_whitespace(lowered)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > self.keep:
            self.known = {b"": b""}
        pieces = list(map(self.known.get, distinct))
        if None in pieces:
            self._learn_words({w for w, ids in zip(distinct, pieces, strict=True) if ids is None})
            pieces = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, pieces), dtype=np.int32, count=len(pieces)) // 4
        start = np.cumsum(size, dtype=np.int32) - size
        flat = np.frombuffer(b"".join(pieces), dtype="<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        ends = np.cumsum(n, dtype=np.int32)
        # Place k of word i comes from start[i] + (k - first place of word i).
        ids = flat[np.repeat(start[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        of_text = words.offsets.to_numpy()
        return ids, np.r_[np.int32(0), ends][of_text[1:] - of_text[0]]

    def _learn_words(self, new: set[bytes]) -> None:
        known, whole, marked = self.known, set(), []
        for w in new:
            core = w.rstrip(_MARKS)
            # Only behind an ASCII letter or digit is a mark surely a pre-token of its own.
            if len(core) < len(w) and core[-1:].isalnum():
                marked.append((w, core, w[len(core) :]))
            else:
                whole.add(w)
        for _, core, marks in marked:
            if core not in known:
                whole.add(core)
            if marks not in known:
                whole.add(marks)
        self._learn(list(whole))
        for w, core, marks in marked:
            known[w] = known[core] + known[marks]


_MARKS = b".,;:!?#%&*$)\"-"


class WholeEncoder:
    """Ids of whole texts from any tokenizer, text by text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.array([], dtype="<u4"), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)


# How a tokenizer must read texts for its ids to be those of the words.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def reads_words(path: str) -> bool:
    """Whether the tokenizer lower-cases, splits at white space and at marks
    behind letters, and ends words with a token that says so."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    special = all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    return (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZER and before[0] == _SPLIT and spec["model"].get("end_of_word_suffix") == "</w>" and special


def encoder(path: str) -> WordEncoder | WholeEncoder:
    """One for each worker process, which runs many tasks."""
    store = process_store()
    if ("encoder", path) not in store:
        store["encoder", path] = WordEncoder(path) if reads_words(path) else WholeEncoder(path)
    return store["encoder", path]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, crc = encoder(path).encode, zlib.crc32
        for rb in batches:
            rows_at_once = max(1, int(rb.num_rows * BATCH_BYTES / max(BATCH_BYTES, rb.column(1).nbytes)))
            for lo in range(0, rb.num_rows, rows_at_once):
                docs = rb.column(0).slice(lo, rows_at_once).to_pylist()
                ids, ends = encode(rb.column(1).slice(lo, rows_at_once))
                raw, first = memoryview(ids).cast("B"), 0
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, last in zip(docs, ends.tolist(), strict=True):
                    n = last - first + 1  # with the end id
                    for k, at in enumerate(range(0, n, capacity)):
                        own = min(capacity, n - at)
                        code = crc(raw[4 * (first + at) : 4 * min(last, first + at + own)])
                        code = crc(end, code) if at + own == n else code
                        for column, value in zip(out, (doc, k, at, own, code), strict=True):
                            column.append(value)
                    first = last
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- the solver: driver side, over the histogram of lengths ------------------

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def _pattern(items: list[int]) -> Pattern:
    out: dict[int, int] = defaultdict(int)
    for x in items:
        out[x] += 1
    return tuple(sorted(out.items(), reverse=True))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: bins with equal contents move together."""
    rooms: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    order: list[int] = []
    done: list[tuple[list[int], int]] = []

    def put(items: list[int], times: int, room: int) -> None:
        if not room:
            done.append((items, times))
            return
        if not rooms[room]:
            order.insert(bisect_right(order, room), room)
        rooms[room].append((items, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(order, length - 1)
            if at == len(order):
                each = capacity // length
                if full := left // each:
                    put([length] * each, full, capacity - each * length)
                if rest := left % each:
                    put([length] * rest, 1, capacity - rest * length)
                break
            room = order[at]
            items, times = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            each = min(room // length, max(1, left // times))
            used = min(times, left // each)
            if used < times:
                put(items, times - used, room)
            put(items + [length] * each, used, room - each * length)
            left -= used * each
    for groups in rooms.values():
        done += groups
    return [(_pattern(items), times) for items, times in done]


class _Left:
    """Counts by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, pattern: Pattern, times: int) -> None:
        for length, copies in pattern:
            self.n[length] -= copies * times
            if not self.n[length]:
                self.lengths.pop(bisect_right(self.lengths, length) - 1)

    def give(self, pattern: Pattern, times: int) -> None:
        for length, copies in pattern:
            if not self.n[length]:
                self.lengths.insert(bisect_right(self.lengths, length), length)
            self.n[length] += copies * times


def _dominated(filling: list[int], slack: int, left: _Left, used: dict[int, int]) -> bool:
    """Whether a longer piece could stand for one or two of the filling's: the
    filling is then dominated by the one that has it."""

    def stands(low: int, at_least: int) -> bool:
        at = bisect_right(left.lengths, low + slack) - 1
        while at >= 0 and left.lengths[at] >= at_least:
            x = left.lengths[at]
            if left.n[x] > used.get(x, 0):
                return True
            at -= 1
        return False

    if any(stands(a, a + 1) for a in set(filling)):
        return True
    pairs = {tuple(sorted((a, b))) for k, a in enumerate(filling) for b in filling[k + 1 :]}
    return any(stands(a + b, a + b) for a, b in pairs)


def completions(left: _Left, first: int, capacity: int, limits: Limits) -> tuple[list[list[int]], bool]:
    """Undominated fillings beside a piece of length ``first``, fullest first,
    and whether they are all of them."""
    room = capacity - first
    n = {first: 1}

    def has(x: int, extra: int = 0) -> bool:
        return x > 0 and left.n.get(x, 0) - n.get(x, 0) - extra > 0

    if not room:
        return [[]], True
    if has(room):  # one piece that leaves no room stands for any other filling
        return [[room]], True
    found: list[tuple[int, list[int]]] = []
    if limits.width is not None:
        at, tries = bisect_right(left.lengths, room) - 1, 0
        while at >= 0 and 2 * left.lengths[at] >= room and tries < capacity:  # exact pairs
            a = left.lengths[at]
            if has(a) and has(room - a, int(a == room - a)):
                found.append((0, [a, room - a]))
                if len(found) == limits.width:
                    break
            at, tries = at - 1, tries + 1
        if found:
            return [f for _, f in found], False
    nodes, whole = 0, True

    def grow(items: list[int], rest: int, top: int) -> bool:
        """Whether the search may stop."""
        nonlocal nodes, whole
        nodes += 1
        at = bisect_right(left.lengths, min(rest, top)) - 1
        ended = True
        if has(rest) and rest <= top:
            found.append((0, [*items, rest]))
            if limits.width is not None:
                whole = False
                return len([1 for s, _ in found if not s]) >= 2
        tried = 0
        while at >= 0:
            if (limits.children is not None and tried >= limits.children) or (limits.effort is not None and nodes >= limits.effort):
                whole = False
                break
            x = left.lengths[at]
            if has(x):
                ended = False
                n[x] = n.get(x, 0) + 1
                stop = grow([*items, x], rest - x, x)
                n[x] -= 1
                if stop:
                    return True
                tried += 1
            at -= 1
        if ended and not any(has(x) and x <= rest for x in left.lengths[: bisect_right(left.lengths, rest)]):
            found.append((rest, items))
        return False

    grow([], room, room)
    found.sort(key=lambda x: (x[0], len(x[1])))
    out: list[list[int]] = []
    for slack, items in found:
        used: dict[int, int] = {first: 1}
        for x in items:
            used[x] = used.get(x, 0) + 1
        if items not in out and (not out or not _dominated(items, slack, left, used)):
            if limits.width is not None and len(out) == limits.width:
                whole = False
                break
            out.append(items)
    return out or [[]], whole


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: over all thresholds, pieces too long to meet
    one of at least the threshold have bins of their own, and what the other
    long pieces leave free holds only so much of the middle ones."""
    n = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in counts.items():
        n[k] = v
    count, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(0, half + 1)  # the threshold
    long = count[capacity] - count[capacity - a]
    middle, middle_volume = count[capacity - a] - count[half], volume[capacity - a] - volume[half]
    short = volume[half] - np.where(a > 0, volume[np.maximum(a - 1, 0)], 0)
    rest = short - (middle * capacity - middle_volume)
    return int((long + middle + np.maximum(0, -(-rest // capacity))).max())


@dataclass(frozen=True)
class Solution:
    plan: list[tuple[Pattern, int]]
    bins: int
    #: No packing has fewer bins than this.
    bound: int
    #: Whether ``bins`` is known to be the least number.
    proven: bool


def solve(counts: dict[int, int], capacity: int = CAPACITY, limits: Limits = LIMITED) -> Solution:
    """The fewest bins that the search finds; it stops at the lower bound, at its
    end, or after ``limits.nodes`` steps, with the best packing so far."""
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    counts = {k: v for k, v in counts.items() if v > 0}
    if not counts:
        return Solution([], 0, 0, True)
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(t for _, t in best)
    left = _Left(counts)
    path: list[tuple[Pattern, int]] = []
    stack: list[list[tuple[list[int], int]]] = []
    waste = bins = nodes = 0
    whole = True

    def branches() -> list[tuple[list[int], int]]:
        """Fillings and how often each is used at most, the best last."""
        nonlocal whole
        first = left.lengths[-1]
        found, complete = completions(left, first, capacity, limits)
        whole &= complete and (limits.one_by_one or len(found) == 1)
        return [([first, *c], 1 if limits.one_by_one else sys.maxsize) for c in reversed(found)]

    stack.append(branches())
    while stack and fewest > bound:
        if limits.nodes is not None and nodes >= limits.nodes:
            whole = False
            break
        if not stack[-1]:
            stack.pop()
            if path:
                pattern, times = path.pop()
                left.give(pattern, times)
                waste -= times * (capacity - sum(a * b for a, b in pattern))
                bins -= times
            continue
        nodes += 1
        items, most = stack[-1].pop()
        pattern = _pattern(items)
        times = min(most, *(left.n[a] // b for a, b in pattern))
        lost = times * (capacity - sum(a * b for a, b in pattern))
        # The last bin's room is no waste that could be avoided; a packing with
        # fewer bins than the incumbent can afford so much in all.
        if waste + lost > (fewest - 1) * capacity - total:
            if times > 1 and waste + lost // times <= (fewest - 1) * capacity - total:
                times = max(1, ((fewest - 1) * capacity - total - waste) // max(1, lost // times))
                lost = times * (capacity - sum(a * b for a, b in pattern))
            else:
                continue
        left.take(pattern, times)
        path.append((pattern, times))
        waste, bins = waste + lost, bins + times
        if not left.lengths:
            if bins < fewest:
                best, fewest = list(path), bins
            pattern, times = path.pop()
            left.give(pattern, times)
            waste, bins = waste - lost, bins - times
            continue
        stack.append(branches())
    return Solution(best, fewest, bound, fewest == bound or whole)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, limits: Limits = LIMITED) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; fewest bins found."""
    return solve(counts, capacity, limits).plan


def placement(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Intervals (length, first rank, first sequence, copies, offset), sorted:
    the pieces of a length, by rank, go to consecutive sequences."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length, copies in pattern:
            rows.append((length, rank[length], sequence, copies, offset))
            rank[length] += times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, limits: Limits = LIMITED) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and on every row sequences (their number) and
    sequences_bound (no packing has fewer)."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, id_col, text_col, path=path, capacity=capacity, end_id=end_id)
    pieces = cut(pieces)
    salts = max(SALTS, -(-pieces.count() // SALT_ROWS))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    # At most a row for each possible length, whatever the corpus holds.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    best = solve(counts, capacity, limits)
    places = spark.sparkContext.broadcast(placement(best.plan))
    before = parts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(before, ["length", "salt"]).withColumn("rank", F.row_number().over(within) - 1 + F.col("before"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = places.value
        starts = table[:, 0] * (1 << 48) + table[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            row = table[np.searchsorted(starts, length * (1 << 48) + rank, side="right") - 1]
            k = rank - row[:, 1]
            yield pdf.drop(columns="rank").assign(sequence_id=row[:, 2] + k // row[:, 3], offset=row[:, 4] + k % row[:, 3] * length)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(put, schema)
    return out.withColumns({"sequences": F.lit(best.bins).cast("long"), "sequences_bound": F.lit(best.bound).cast("long")})
