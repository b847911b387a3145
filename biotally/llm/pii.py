"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds are decided by pattern and checksum alone. The kinds the method
adds (iban by mod 97, ssn, domestic phone numbers, mac addresses) carry a score
that words nearby raise or lower, and count from ``threshold`` on.

A text without digits or @ can hold none of it; such texts are recognised by
Spark and never sent to Python. Every pattern runs in time linear in the text.

Defined cases: null texts are empty and have no spans; repeated rows each give
a row; an empty table gives an empty result; offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "domestic_phone", "mac")
KINDS = BASE + ADDED
THRESHOLD = 0.5
#: Code points before and after a span that context is read from.
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_PART = re.compile(r"0*([0-9]*)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DOMESTIC = re.compile(r"(?<![0-9+)(.-])(?<!\+[0-9] )(?<!\+[0-9][0-9] )\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
_NEAR = {
    "iban": re.compile(r"\b(?:iban|bank|account|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|tax id)\b", re.I),
    "domestic_phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon|téléphone|teléfono)\b", re.I),
    "mac": re.compile(r"\b(?:mac|ethernet|wifi|bluetooth|device|hardware)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:example|sample|order|invoice|version|isbn|page|serial|sku)\b", re.I)
#: Score of a confirmed span before context.
_PRIOR = {"iban": 0.8, "ssn": 0.4, "domestic_phone": 0.4, "mac": 0.6}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the whole run before an @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, 1.0) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := _IP_PART.fullmatch(x)[1]) < 3 or len(p) == 3 and int(p) <= 255 for x in m[0].split(".")):
            out.append(Span("ip", *m.span(), 1.0))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(Span("card", *m.span(), 1.0))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span("phone", *m.span(), 1.0))
    return out


def added_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    out = []
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("domestic_phone", _DOMESTIC), ("mac", _MAC)):
        for m in pattern.finditer(text):
            if kind == "iban" and not (15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s)):
                continue
            near = text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]
            score = round(_PRIOR[kind] + 0.3 * bool(_NEAR[kind].search(near)) - 0.2 * bool(_AGAINST.search(near)), 3)
            if score >= threshold:
                out.append(Span(kind, *m.span(), score))
    return out


def find_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans by start, then kind in the order of KINDS."""
    spans = base_spans(text) + added_spans(text, threshold)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and an array of spans (kind, start, end, score), one row a document."""
    schema = "array<struct<kind: string, start: long, end: long, score: double>>"

    @F.pandas_udf(schema)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in find_spans(t, threshold)] if t else [] for t in texts])

    text = whole_text(text_col)
    candidate = F.when(text.rlike("[@0-9]|[A-Fa-f]{2}:[A-Fa-f]{2}:"), text).otherwise(F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), spans(candidate).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of spans
    that overlap, the earliest and longest stands."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            parts, at = [], 0
            for s in sorted(find_spans(text, threshold), key=lambda s: (s.start, -s.end)):
                if s.start >= at:
                    parts += [text[at : s.start], f"[{s.kind}]"]
                    at = s.end
            return "".join([*parts, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, masked(F.col(text_col)))


def digest(spans: list) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def base_sha256(text: str) -> str:
    spans = sorted(base_spans(text), key=lambda s: (s.start, BASE.index(s.kind)))
    return hashlib.sha256(digest(spans).encode()).hexdigest()
