"""Operator 4: licence scan by a positional rare-token index (DataFrame functions only).

Templates are passages of licences as word sequences, with mandatory key phrases.
Document frequencies of the template words over the whole corpus (a row per word) give
every word its inverse document frequency. In each file and for each template, the
file's own words of highest IDF among the template's words are looked up (``PROPOSERS``
of them at most): every place of such a word, less each place that the word has in the
template, is a start it speaks for. The starts that two of them agree on (relative
positions that intersect) are compared word by word: their score is the share of the
template's IDF that stands in place. A template is found where that is ``ENOUGH`` and every
key phrase stands within the span. Phrases of the base scan need every word in place, and
start from the rarest.

A file without the rarest word of any base phrase or key phrase can hold none of them, so
only the others are looked into; this filter loses nothing.

Defined cases: null text is empty (no words, no labels, score 0); repeated rows are
scanned alike; extra columns pass through ``scan`` whatever their names, but one that has
the name of an output gives way to it; empty tables give empty tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import carried, carry

WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
LETTER = "[0-9A-Za-z\\x80-\\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed phrases and labels of the base scan.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    """A passage of a licence, its words in order; ``keys``: phrases that must stand within its span."""

    label: str
    words: str
    keys: tuple[str, ...]


#: Passages of public licences and their notices as lower-case words, with their labels.
TEMPLATES = (
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "obtaining a copy")),
    Template("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("modify merge publish distribute sublicense",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    Template("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", ("redistributions in binary form", "above copyright notice")),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2",)),
)
#: Share of a template's IDF that must be in place.
ENOUGH = 0.75
#: A file's words of highest IDF, of each template, that propose starts.
PROPOSERS = 3


def vocabulary() -> list[str]:
    phrases = [*BASE, *(t.words for t in TEMPLATES), *(k for t in TEMPLATES for k in t.keys)]
    return sorted({w for p in phrases for w in p.split()})


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text; on lower-case text the class leaves out nothing that the definition has."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Rows of ``docs``, and in how many of them each template word stands."""
    split = F.split(lowered(F.coalesce(F.col(text), F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", -1)
    hits = F.array_intersect(split, F.array(*map(F.lit, vocabulary())))
    rows = docs.select(F.explode_outer(F.concat(F.array(F.lit("")), hits)).alias("word")).groupBy("word").count().collect()
    found = {r["word"]: r["count"] for r in rows}
    return found.pop("", 0), found


def weights(n: int, found: dict[str, int]) -> dict[str, float]:
    """Inverse document frequency of each template word."""
    return {w: math.log((n + 1) / (found.get(w, 0) + 0.5)) for w in vocabulary()}


def rarest(phrase: str, idf: dict[str, float]) -> list[str]:
    """The phrase's words, the highest IDF first."""
    return sorted(dict.fromkeys(phrase.split()), key=lambda w: (-idf[w], w))


def strings(words_: list[str]) -> Column:
    return F.array(*map(F.lit, words_))


def places_of(word: Column | str) -> Column:
    """Places of a word in the file."""
    return F.transform(F.filter("_hits", lambda h: h["w"] == word), lambda h: h["i"])


def starts(phrase: str, idf: dict[str, float]) -> Column:
    """Places where all words of a phrase stand in order, from those of its rarest word."""
    sequence = phrase.split()
    k = sequence.index(rarest(phrase, idf)[0])
    proposed = F.transform(places_of(sequence[k]), lambda i: i - k)
    return F.filter(proposed, lambda s: (s >= 0) & (F.slice("_words", F.greatest(s, F.lit(0)) + 1, len(sequence)) == strings(sequence)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def index_of(idf: dict[str, float]) -> Column:
    """The templates as a literal array: label, words in order with their IDF, words by IDF, each word's places, key phrases and their rarest word."""

    def entry(t: Template) -> Column:
        sequence, by_idf = t.words.split(), rarest(t.words, idf)
        return F.struct(
            F.lit(t.label).alias("label"),
            F.array(*(F.struct(F.lit(w).alias("w"), F.lit(idf[w]).alias("x")) for w in sequence)).alias("words"),
            F.lit(math.fsum(idf[w] for w in sequence)).alias("total"),
            strings(by_idf).alias("by_idf"),
            F.map_from_arrays(strings(by_idf), F.array(*(F.array(*(F.lit(k) for k, x in enumerate(sequence) if x == w)) for w in by_idf))).alias("places"),
            F.array(*(F.lit(f" {k} ") for k in t.keys)).alias("keys"),
            F.lit(rarest(" ".join(t.keys), idf)[0]).alias("anchor"),
        )

    return F.array(*map(entry, TEMPLATES))


def matches(index: Column, present: Column) -> Column:
    """label and score of each template: the best start that holds its key phrases (0 if none does). present: template words of the file."""

    def spoken(t: Column, word: Column) -> Column:
        starts_ = F.transform(places_of(word), lambda i: F.transform(F.element_at(t["places"], word), lambda p: i - p))
        return F.coalesce(F.array_distinct(F.flatten(starts_)), F.array().cast("array<int>"))

    def agreed(spoke: Column) -> Column:
        pairs = [F.array_intersect(F.get(spoke, F.lit(i)), F.get(spoke, F.lit(j))) for i in range(PROPOSERS) for j in range(i)]
        return reduce(F.array_union, (F.coalesce(x, F.array().cast("array<int>")) for x in pairs))

    def score(t: Column, s: Column) -> Column:
        def of(span: Column) -> Column:
            in_place = F.aggregate(F.zip_with(span, t["words"], lambda w, x: F.when(w == x["w"], x["x"]).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
            said = F.concat(F.lit(" "), F.array_join(span, " "), F.lit(" "))
            return F.when(F.forall(t["keys"], lambda k: F.contains(said, k)), F.least(in_place / t["total"], F.lit(1.0))).otherwise(F.lit(0.0))

        return let(F.slice("_words", s + 1, F.size(t["words"])), of)

    def best(t: Column, present: Column) -> Column:
        rare = F.slice(F.array_intersect(t["by_idf"], present), 1, PROPOSERS)
        starts_ = let(F.transform(rare, lambda w: spoken(t, w)), agreed)
        found = F.array_max(F.transform(F.filter(starts_, lambda s: s >= 0), lambda s: score(t, s)))
        score_ = F.when(F.array_contains(present, t["anchor"]), F.coalesce(found, F.lit(0.0))).otherwise(F.lit(0.0))
        return F.struct(t["label"].alias("label"), score_.alias("score"))

    return let(present, lambda words_: F.transform(index, lambda t: best(t, words_)))


OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (default: all columns but the text), n_words, n_base, first_word, last_word, base_labels, labels, score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (text.lower(), *OUTPUTS)]
    idf = weights(*frequencies(docs, text))
    # a base match holds its phrase's rarest word, and a template's the rarest of its keys, so texts without any need no postings
    anchors = sorted({rarest(p, idf)[0] for p in (*BASE, *(" ".join(t.keys) for t in TEMPLATES))})
    whole = F.coalesce(F.col("_text"), F.lit(""))
    looked = F.when(whole.rlike(f"(?i)(?<!{LETTER})(?:{'|'.join(anchors)})(?!{LETTER})"), words(lowered(whole)))
    split = carry(docs, keep, _text=F.col(text)).select("row", F.regexp_count(whole, F.lit(WORD)).cast("long").alias("n_words"), looked.alias("_words"))
    placed = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: h["w"].isin(vocabulary()))
    hits = split.select("row", "n_words", "_words", F.coalesce(placed, F.array().cast("array<struct<i:int,w:string>>")).alias("_hits"))
    found = hits.select(
        "row",
        "n_words",
        *(starts(p, idf).alias(f"_base{k}") for k, p in enumerate(BASE)),
        F.when(F.size("_hits") > 0, matches(index_of(idf), F.array_distinct(F.col("_hits.w")))).alias("_found"),
    )
    bases = F.flatten(F.array(*(F.col(f"_base{k}") for k in range(len(BASE)))))
    base_labels = F.array(*(F.when(F.size(f"_base{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())))
    own_labels = F.coalesce(F.transform(F.filter("_found", lambda m: m["score"] >= ENOUGH), lambda m: m["label"]), F.array().cast("array<string>"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")

    return found.select(
        *carried(keep),
        "n_words",
        F.size(bases).cast("long").alias("n_base"),
        F.array_min(bases).cast("long").alias("first_word"),
        F.array_max(bases).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, own_labels)).alias("labels"),
        F.when(F.size(bases) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("_found.score")), F.lit(0.0))).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    return scan(docs, ["doc_id"])
