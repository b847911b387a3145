"""Secret scans through a trigram index.

Each rule's pattern is read into a Boolean query of the trigrams that any match
must hold. The index has, for each trigram that some rule asks for, the ids of
the documents that hold it, cut into ``CHUNKS`` parts by a hash of the id. A
query is answered part by part, by intersecting and uniting the lists of its
trigrams. Candidates are then verified with the rule's pattern; rules that have
no mandatory trigram are tried on every document.

Trigrams are of lower-cased text, so rules of either case share them. Columns
only: match places come from the gaps that splitting by the pattern leaves.

Defined cases: null texts are empty and have no spans; rows that share an id
share candidates and are verified each by its own text; null ids are indexed
too; an empty table gives an empty result; other columns are ignored, and kept
by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser  # the standard library's own reader of patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, key_set, let, maybe_in, running, set_size, whole_text


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group has this many code points.
    group: int = 0
    least: int = 0


# The base kinds of the contract, then public token formats. Where
# a run is matched whole, its least length is in the pattern: a shorter run
# fails either way.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: Parts of each posting list: at ten billion documents one holds some 150,000.
CHUNKS = 65_536
#: Strings that a part of a pattern may stand for, to be read as alternatives.
MOST = 64

# -- Boolean trigram queries ---------------------------------------------------

#: Code points of a part of a text, when spans are cut out of it.
PART = 1024

#: ("all", parts), ("any", parts) or a trigram; ("all", ()) always holds.
Query = tuple | str
ALWAYS: Query = ("all", ())


def _of_string(s: str) -> Query:
    return ("all", tuple(dict.fromkeys(s[k : k + 3] for k in range(len(s) - 2)))) if len(s) >= 3 else ALWAYS


def _both(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p != ALWAYS]
    return parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _either(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return ALWAYS if ALWAYS in parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _strings(node) -> list[str] | None:
    """All strings that the node stands for, lower-cased, if they are few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg).lower()]
    if name == "IN":
        out: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < 16:
                out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else sorted({s for x in each for s in x})
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
        once = _sequence_strings(arg[2])
        if once is None:
            return None
        out, grown = ([""] if arg[0] == 0 else []), [""]
        for k in range(1, arg[1] + 1):
            grown = [a + b for a in grown for b in once]
            if len(grown) > MOST:
                return None
            out += grown if k >= arg[0] else []
        return sorted(set(out))
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MOST:
            return None
        out = [a + b for a in out for b in own]
    return out


def _sequence_query(nodes) -> Query:
    parts: list[Query] = []
    run = [""]

    def close() -> None:
        nonlocal run
        parts.append(_either([_of_string(s) for s in run]))
        run = [""]

    for node in nodes:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= MOST:
            run = [a + b for a in run for b in own]
            continue
        close()
        if own is not None:
            run = own
            continue
        op, arg = node
        if str(op) == "SUBPATTERN":
            parts.append(_sequence_query(arg[-1]))
        elif str(op) == "BRANCH":
            parts.append(_either([_sequence_query(x) for x in arg[1]]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
            parts.append(_sequence_query(arg[2]))
    close()
    return _both(parts)


def trigram_query(pattern: str) -> Query:
    """What trigrams of lower-cased text any match of the pattern implies."""
    return _sequence_query(parser.parse(pattern))


def trigrams(query: Query) -> list[str]:
    if isinstance(query, str):
        return [query]
    return list(dict.fromkeys(g for part in query[1] for g in trigrams(part)))


def _matching(query: Query, lists: Column, number: dict[str, int]) -> Column:
    """The ids of a part's documents that the query holds for."""
    if isinstance(query, str):
        return F.coalesce(F.get(lists, F.lit(number[query])), F.array().cast("array<string>"))
    out = None
    for part in query[1]:
        own = _matching(part, lists, number)
        out = own if out is None else F.array_intersect(out, own) if query[0] == "all" else F.array_union(out, own)
    return out


# -- index, candidates, verification ------------------------------------------


def id_key(id_col: str) -> Column:
    """The id as a string; null told apart from every id."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: gram (its number in ``grams``), chunk, ids."""

    def held(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(g)), F.lit(k)) for k, g in enumerate(grams)]))

    rows = docs.select(id_key(id_col).alias("id"), F.explode(let(F.lower(whole_text(text_col)), held)).alias("gram"))
    return rows.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(CHUNKS)).cast("int").alias("chunk")).agg(F.collect_set("id").alias("ids"))


def candidates(index: DataFrame, queries: dict[str, Query], grams: list[str]) -> DataFrame:
    """(id, kinds): the rules whose queries the postings answer with the id."""
    number = {g: k for k, g in enumerate(grams)}
    parts = index.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("posting"))
    # A posting list for each gram of the vocabulary, in its place.
    lists = F.transform(F.sequence(F.lit(0), F.lit(len(grams) - 1)), lambda k: F.try_element_at(F.col("posting"), k))
    found = let(lists, lambda own: F.array(*[F.struct(F.lit(kind).alias("kind"), _matching(q, own, number).alias("ids")) for kind, q in queries.items()]))
    rows = parts.select(F.explode(found).alias("f")).select(F.col("f.kind").alias("kind"), F.explode("f.ids").alias("id"))
    return rows.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


SPANS = "array<struct<start: long, n: int, kind: string, end: long>>"


def spans(text: Column, rule: Rule, n: int) -> Column:
    """Spans of the rule's leftmost non-overlapping matches."""
    whole = f"({rule.pattern})"

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: (F.length(p["gap"]) + F.length(p["found"])).cast("long"))
        each = F.zip_with(parts, running(lengths, lambda x, y: x + y), lambda p, end: F.struct((end - F.length(p["found"])).alias("start"), end.alias("end"), (F.length(p["value"]) >= rule.least).alias("ok")))
        return F.transform(F.filter(each, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")))

    # The gap after the last match has no match beside it.
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)).alias("gap"), found.alias("found"), F.regexp_extract_all(text, F.lit(whole), F.lit(rule.group + 1 if rule.group else 0)).alias("value"))
    return F.when(text.rlike(rule.pattern), let(parts, placed)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, keep: str | None = None) -> DataFrame:
    """doc_id, text, spans (start, n, kind, end) sorted; n is the rule's number.
    ``keep`` names a struct column to carry."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: q for kind, q in queries.items() if q != ALWAYS}
    grams = list(dict.fromkeys(g for q in indexed.values() for g in trigrams(q)))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *([F.col(keep).alias("kept")] if keep else []))
    if indexed:
        found = cut(candidates(postings(docs, grams, id_col, text_col), indexed, grams).withColumnRenamed("id", "candidate"))
        # Only documents that may be candidates are shuffled to meet their rules:
        # the bitmap has 16 bits and more a candidate, up to 64 MB in all.
        bits = set_size(found.count())
        rows = maybe_in(rows.withColumn("id", id_key("doc_id")), key_set(found, "candidate", bits=bits), "maybe", "id", bits=bits)
        met = rows.where("maybe").join(found, F.col("id") == F.col("candidate"), "left").drop("candidate", "maybe", "id")
        rows = rows.where("not maybe").drop("maybe", "id").withColumn("kinds", F.lit(None).cast("array<string>")).unionByName(met)
    each = []
    for n, rule in enumerate(rules):
        own = spans(F.col("text"), rule, n)
        each.append(F.when(F.array_contains("kinds", rule.kind), own).otherwise(F.array().cast(SPANS)) if rule.kind in indexed else own)
    return rows.select("doc_id", "text", *(["kept"] if keep else []), F.sort_array(F.concat(*each)).alias("spans"))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text cut into parts of ``PART``: only
    the parts that they touch are read."""
    first = F.floor(start / PART).cast("int")
    own = F.array_join(F.slice(parts, first + 1, F.floor((end - 1) / PART).cast("int") - first + 1), "")
    return F.when(end <= start, "").otherwise(F.substring(own, (start - first * PART + 1).cast("int"), (end - start).cast("int")))


def _masked(parts: Column, spans: Column) -> Column:
    """The text with its spans replaced. A span counts if it starts behind all
    earlier ones; what lies between those that count is cut out, and all is
    joined once."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    zero = F.lit(0).cast("long")

    def joined(ends: Column) -> Column:
        each = F.transform(spans, lambda s, k: F.struct(F.when(k == 0, zero).otherwise(F.get(ends, k - 1)).alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))
        kept = F.filter(each, lambda s: s["to"] >= s["from"])
        cut = F.transform(kept, lambda s: F.concat(_between(parts, s["from"], s["to"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(cut, ""), _between(parts, F.element_at(ends, -1), F.length("text").cast("long")))

    return let(ends, joined)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every secret replaced by its kind in brackets; of
    spans that overlap, the first stands for all. Texts without secrets, null
    ones too, stay as they are."""
    row = fresh(docs, "row")
    found = scan(docs.withColumn(row, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), id_col, text_col, rules=rules, keep=row)
    masked = let(F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), lambda parts: _masked(parts, F.col("spans")))
    found = found.withColumn("masked", F.when(F.size("spans") > 0, masked))
    new = {text_col: F.coalesce("masked", F.col("kept")[text_col])}
    if chars_col in docs.columns:
        new[chars_col] = F.coalesce(F.length("masked").cast("long"), F.col("kept")[chars_col])
    return found.select(*[new.get(c, F.col("kept")[c]).alias(c) for c in docs.columns])
