"""License scans by a positional index of rare words.

Texts become words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Base phrases are
searched where their words stand one after another. The method: of each licence notice (template)
the words of highest inverse document frequency in its mandatory key phrase are indexed with their
positions; a document's words are looked up, postings that meet at one relative position propose a
template there, and it is accepted if the key phrase stands at that place and enough of its words
do. As the whole key phrase must stand, no place is missed. Document frequencies are counted over all
documents.

All columns are DataFrame functions on single rows; the only thing counted across rows is the
documents for each word of the templates. Null and empty texts have no words, no labels, score 0.
Rows with one doc_id are scanned one by one. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import ascii_lower, let, text_of, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels, fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of templates that are not indexed, fixed values.
COMMON = frozenset("the of and or in to is this any a by for with are from under all be must as".split())
#: Words of key phrases that alone don't make a document worth looking at, fixed values.
WEAK = frozenset(
    "use free copy version source software 2 3 4 0 nc sa general public rights permission granted charge binary forms code work above notice "
    "products derived promote included portions related held damages arising authors either foundation international copies agpl apache bsd gpl mit gnu".split()
)
#: Rarest words of a key phrase that are indexed and must meet, share of a template's words that must stand.
MEET, COVER = 2, 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str


#: Licence notices, headers and tags with their mandatory key phrases, fixed values.
TEMPLATES = (
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    Template("agpl-3.0", "spdx license identifier agpl 3 0", "spdx license identifier agpl 3"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2"),
    Template("apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    Template("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    Template("bsd", "spdx license identifier bsd 3 clause", "spdx license identifier bsd"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2 of the license"),
    Template("gpl-2.0", "spdx license identifier gpl 2 0", "spdx license identifier gpl 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3 of the license"),
    Template("gpl-3.0", "spdx license identifier gpl 3 0", "spdx license identifier gpl 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "included in all copies or substantial portions"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "spdx license identifier mit", "spdx license identifier mit"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "authors be held liable for any damages arising"),
)
VOCABULARY = sorted({w for t in TEMPLATES for w in t.text.split()} - COMMON)
#: Words of which every key phrase and base phrase holds one at least: a document without them holds none.
STRONG = sorted({w for phrase in (*(t.key for t in TEMPLATES), *BASE) for w in phrase.split()} - COMMON - WEAK)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def constant(value, kind: str) -> Column:
    """A nested constant, folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def base_places(words: Column) -> Column:
    """(start, label) of every place of a base phrase."""

    def at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE.items():
            here = F.lit(True)
            for k, w in enumerate(phrase.split()):
                here = here & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
            out = F.when(here, F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("start"), out.alias("label"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at), lambda x: x["label"].isNotNull())


def found_labels(words: Column, rarity: list[int]) -> Column:
    """(label, share) of accepted templates. rarity: of the words of VOCABULARY, the rarest highest."""
    rare = dict(zip(VOCABULARY, rarity, strict=True))
    texts = [t.text.split() for t in TEMPLATES]
    keys = [t.key.split() for t in TEMPLATES]
    offsets = [next(i for i in range(len(x)) if x[i : i + len(k)] == k) for x, k in zip(texts, keys, strict=True)]
    postings: dict[str, list[dict[str, int]]] = {}
    for t, (key, at) in enumerate(zip(keys, offsets, strict=True)):
        for k in sorted((k for k, w in enumerate(key) if w in rare), key=lambda k: (-rare[key[k]], k))[:MEET]:  # noqa: B023
            postings.setdefault(key[k], []).append({"t": t, "k": at + k})
    index = constant(list(postings.values()), "array<array<struct<t:int,k:int>>>")
    shelf = constant(
        [{"label": t.label, "words": x, "key": k, "at": o} for t, x, k, o in zip(TEMPLATES, texts, keys, offsets, strict=True)],
        "array<struct<label:string,words:array<string>,key:array<string>,at:int>>",
    )
    indexed = strings(postings)
    seen = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(indexed, w).cast("int").alias("v"), i.alias("i"))), lambda o: o["v"] > 0)

    def aligned(occ: Column) -> Column:
        hits = F.flatten(F.transform(occ, lambda o: F.transform(F.get(index, o["v"] - 1), lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["k"]).alias("d")))))
        twice = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + (MEET - 1))))
        return let(F.array_sort(hits), twice)

    def checked(x: Column) -> Column:
        def one(t: Column) -> Column:
            same = lambda want, at: F.filter(F.transform(want, lambda w, k: F.coalesce(F.get(words, at + k), F.lit("")) == w), lambda y: y)
            key = F.size(same(t["key"], x["d"] + t["at"])) == F.size(t["key"])
            share = F.size(same(t["words"], x["d"])) / F.size(t["words"])
            return F.struct(F.when(key & (share >= COVER), t["label"]).alias("label"), share.alias("share"))

        return let(F.get(shelf, x["t"]), one)

    return F.filter(F.transform(let(seen, aligned), checked), lambda y: y["label"].isNotNull())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    words = docs.select("doc_id", license_words(text_of()).alias("w"))
    worth = F.arrays_overlap("w", strings(STRONG))
    known = F.array_intersect("w", strings(VOCABULARY)).alias("known")  # of every document: frequencies are those of all
    kept = written(words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(worth, F.col("w")).alias("w"), known), "license-words")
    total = kept.count()
    each = kept.select(F.explode("known").alias("word"))
    held = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    rarity = [round(1000 * math.log((1 + total) / (1 + held.get(w, 0)))) for w in VOCABULARY]
    base = F.when(F.col("w").isNull(), F.array().cast("array<struct<start:bigint,label:string>>")).otherwise(base_places(F.col("w")))
    more = F.when(F.col("w").isNull(), F.array().cast("array<struct<label:string,share:double>>")).otherwise(found_labels(F.col("w"), rarity))
    out = kept.select("doc_id", "n_words", base.alias("base"), more.alias("more"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max(F.transform("more", lambda x: x["share"])), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["start"].alias("first_word"), F.get("base", F.size("base") - 1)["start"].alias("last_word"),
        listed(names(F.col("base"))).alias("base_labels"), listed(F.concat(names(F.col("base")), names(F.col("more")))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
