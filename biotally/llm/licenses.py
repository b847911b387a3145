"""License scans with a positional index of rare licence words.

Templates are word sequences of licence texts. The corpus says how rare each
template word is (inverse document frequency over all files). Each template is
indexed under its rarest places: as many as may be altered in it, and two more.
A file looks up the indexed words that it holds; each place of such a word, less
its place in the template, proposes where the template starts, and a start that
fewer of a template's indexed places agree on than must be left in it is out.
What is proposed stands when enough of the template's words, and its mandatory
key phrase, are in place. No start with enough words is missed, and a file's
work depends on the licence words it holds, not on the number of templates.

Two passes over the texts and no shuffle of them; between the passes the driver
holds one count for each template word. Columns only.

Defined cases: null and empty texts have no words; repeated rows each give a
row; an empty table gives an empty result; other columns are ignored; texts that
repeat licence words however often are read whole.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text

#: What stands between words, once letters are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Share of the words that must be found in place.
    share: float = 1.0
    #: Words, as in ``text``, that must all be found in place; by default all of them.
    key: str = ""
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> list[int]:
        key = self.key.split() or self.words
        at = next(k for k in range(len(self.words)) if self.words[k : k + len(key)] == key)
        return [*range(at, at + len(key))]


# The phrases and labels of the contract, then public licence texts.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", 0.8, "to deal in the software without restriction"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8, "free of charge"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.8, "substantial portions of the software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8, "source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8, "must retain"),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", 0.8, "must reproduce"),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", 0.8, "endorse or promote"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.8, "with or without fee"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8, "with or without fee"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8, "except in compliance with the license"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", 0.8, "agreed to in writing"),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.8, "either version 3"),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.8, "either version 2"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", 0.8, "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8, "unencumbered software"),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", 0.8, "commercial or non commercial"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", 0.8, "held liable for any damages"),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 0.8, "any person or organization"),
)
#: Indexed places of a template that must be left in it, where it has so many.
AGREE = 2


def words(text: Column) -> Column:
    # Words hold no capital of A-Z, so lower() and lowering A-Z alone agree on
    # where words stand and on every template word.
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Files, and files that hold each word of the vocabulary."""
    present = F.array_intersect(words(whole_text(text_col)), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.array_append(present, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}  # a row for each word of the vocabulary at most
    return found.pop("", 0), found


@dataclass(frozen=True)
class Index:
    """Where rare words stand in which templates."""

    templates: tuple[Template, ...]
    #: word -> (template, place), the rarest word first.
    postings: dict[str, list[tuple[int, int]]]
    #: Indexed places that must agree on a start, by template.
    agree: list[int]


def index_of(templates: tuple[Template, ...], rarity: dict[str, float]) -> Index:
    found: dict[str, list[tuple[int, int]]] = {}
    agree = []
    for t, template in enumerate(templates):
        w = template.words
        altered = len(w) - math.ceil(template.share * len(w) - 1e-9)
        places = sorted(range(len(w)), key=lambda k: (-rarity[w[k]], w[k], k))[: altered + AGREE]
        agree.append(len(places) - altered)
        for k in places:
            found.setdefault(w[k], []).append((t, k))
    return Index(templates, {x: found[x] for x in sorted(found, key=lambda x: (-rarity[x], x))}, agree)


def _constant(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps({"x": value})), f"struct<x: {schema}>")["x"]


def matches(w: Column, held: Column, index: Index) -> Column:
    """Places where templates stand in the words w, of which ``held`` are indexed:
    structs of label, base, start and score."""
    lookup = _constant({x: [{"t": t, "k": k} for t, k in p] for x, p in index.postings.items()}, "map<string, array<struct<t: int, k: int>>>")
    facts = _constant([{"label": t.label, "base": t.base, "words": t.words, "share": t.share - 1e-9, "key": t.key_places, "agree": n} for t, n in zip(index.templates, index.agree, strict=True)], "array<struct<label: string, base: boolean, words: array<string>, share: double, key: array<int>, agree: int>>")

    def proposed(i: Column) -> Column:
        return F.transform(F.element_at(lookup, F.get(w, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["k"]).alias("start")))

    def agreed(all_of: Column) -> Column:
        """Each start once, if enough of the sorted proposals name it."""
        again = lambda x, i: F.get(all_of, i + F.get(facts, x["t"])["agree"] - 1) == x
        return F.filter(all_of, lambda x, i: (x["start"] >= 0) & ((i == 0) | (F.get(all_of, i - 1) != x)) & F.coalesce(again(x, i), F.lit(False)))

    def judged(x: Column) -> Column:
        fact = F.get(facts, x["t"])
        inside = lambda k: F.coalesce(F.get(w, x["start"] + k) == F.get(fact["words"], k), F.lit(False))
        hits = F.size(F.filter(F.sequence(F.lit(0), F.size(fact["words"]) - 1), inside))
        return F.struct(fact["label"].alias("label"), fact["base"].alias("base"), x["start"].alias("start"), (hits / F.size(fact["words"])).alias("score"), (F.forall(fact["key"], inside) & (hits / F.size(fact["words"]) >= fact["share"])).alias("stands"))

    at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(held, F.get(w, i)))
    found = let(F.sort_array(F.flatten(F.transform(at, proposed))), agreed)
    return F.transform(F.filter(F.transform(found, judged), lambda x: x["stands"]), lambda x: F.struct(x["label"].alias("label"), x["base"].alias("base"), x["start"].alias("start"), x["score"].alias("score")))


PLACES = "array<struct<label: string, base: boolean, start: int, score: double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (label, base, start, score), one row a document."""
    vocabulary = sorted({w for t in templates for w in t.words})
    n, held = document_frequencies(docs, text_col, vocabulary)
    index = index_of(templates, {w: math.log((1 + n) / (1 + held.get(w, 0))) for w in vocabulary})
    rare = F.array(*map(F.lit, index.postings))

    def of(w: Column) -> Column:
        # Files without any indexed word are done at one look.
        places = let(F.array_intersect(rare, w), lambda own: F.when(F.size(own) > 0, matches(w, own, index)).otherwise(F.array().cast(PLACES)))
        return F.struct(F.size(w).cast("long").alias("n_words"), places.alias("places"))

    rows = docs.select(F.col(id_col).alias("doc_id"), let(words(whole_text(text_col)), of).alias("found"))
    return rows.select("doc_id", "found.n_words", "found.places")


def labels(places: Column) -> Column:
    """Distinct labels, sorted, comma-joined."""
    return F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
