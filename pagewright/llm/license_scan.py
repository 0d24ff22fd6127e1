"""License scans by a positional index of rare template words.

Templates are notices, phrases and identifier lines of known licences as word sequences; each has mandatory key phrases.
One pass over the texts finds which template words each file has, and where. Their document frequencies in the corpus
give licence words their IDF. As key phrases must be whole, a template can only match a file that has the highest-IDF word of its
key phrases, so a file looks up those of its licence words that are this for some template: the choice is by template, not by
a file's own first few words, as those could miss a template whose words are all less rare. Nothing is lost, and files without
such a word are done. For its candidate templates every indexed word at place p of
the file and at place t of a template (the index's posting) votes for the start p - t. Votes that agree on a start
are an exact alignment; exact alignments whose starts differ by DRIFT or less are one alignment, so a notice with inserted
or missing words is still found. An alignment gives the template's label if it covers COVERAGE of its indexed words and
if each key phrase is whole, consecutive in one exact alignment. An identifier line's three words and its name are two key phrases,
so that a name within DRIFT words of its place counts, as in "(MIT OR Apache-2.0)". The base phrases are templates of which all words must
agree on one start, so their places are exact.

All of it runs as DataFrame expressions: the index is a fixed table of about a thousand rows, and votes are
counted by aggregation. A hot document or phrase is spread by document, and texts are split once and never shuffled.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case. Defined cases: null and empty
texts have no words, no labels and score 0. Rows that are equal in doc_id and text get the same result. Starts may be
negative for an alignment whose beginning is cut off, never for a base phrase. Extra columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written

#: The least share of a template's indexed words that must agree, and how far apart their starts may be.
COVERAGE, DRIFT = 0.6, 4
#: Words of so many letters or more are indexed, and all words of key phrases. Templates have MOST_WORDS words at most.
LETTERS, MOST_WORDS = 4, 63

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices by label, as published by the licences' authors; key phrases, which must be whole, stand in brackets.
TEMPLATES = [
    ("agpl", "[gnu affero general public license]"),
    ("apache-2.0", "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "[apache license version 2 0]"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing [software distributed under the license] is [distributed on an as is basis] without warranties or conditions of any kind either express or implied"),
    ("artistic-2.0", "[the artistic license 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "[redistributions of source code must retain the above copyright notice] this list of conditions and the following disclaimer"),
    ("bsd", "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products] derived from this software without specific prior written permission"),
    ("bsl-1.0", "[boost software license version 1 0]"),
    ("cc-by", "licensed under a [creative commons attribution] license"),
    ("cc-by-nc", "[cc by nc]"),
    ("cc-by-nc", "[creative commons attribution noncommercial]"),
    ("cc-by-nd", "[cc by nd]"),
    ("cc-by-sa", "[cc by sa]"),
    ("cc-by-sa", "[creative commons attribution sharealike]"),
    ("cc0", "[cc0 1 0 universal] public domain dedication"),
    ("cddl", "[common development and distribution license]"),
    ("epl", "this program and the accompanying materials are made available under the terms of the [eclipse public license]"),
    ("eupl", "[european union public licence]"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the [gnu free documentation license]"),
    ("gpl", "this program is [free software] you can redistribute it and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty see the [gnu general public license] for [more details]"),
    ("gpl-2.0", "[gnu general public license version 2]"),
    ("gpl-3.0", "[gnu general public license version 3]"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("isc", "the software is provided as is and [the author disclaims all warranties] with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "[gnu lesser general public license]"),
    ("lgpl", "[gnu library general public license]"),
    ("mit", "[permission is hereby granted] [free of charge] to any person [obtaining a copy of this software] and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be [included in all copies] or [substantial portions of the software]"),
    ("mit", "[the software is provided as is] without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and [noninfringement]"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("mpl-2.0", "[mozilla public license v 2 0]"),
    ("ofl", "[sil open font license]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("wtfpl", "[do what the fuck you want to public license]"),
    ("zlib", "this software is provided as is without any express or implied warranty [in no event will the authors be held liable] for any damages arising from the use of this software"),
    ("zlib", "[altered source versions must be plainly marked as such] and must not be misrepresented as being the original software"),
]
#: Names after an identifier line's first three words, in expressions too; each is its own label.
IDENTIFIERS = ["agpl-3.0", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0", "epl-2.0", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-2.0", "unlicense", "zlib"]

_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def templates() -> list[tuple[int, str, bool, int, str, int]]:
    """The index's postings: template, label, base, place, word, and the number of its key phrase, -1 for none."""
    out = [(t, label, True, i, w, 0) for t, (phrase, label) in enumerate(BASE.items()) for i, w in enumerate(phrase.split())]
    lines = [(name, "[spdx license identifier] [" + name.replace("-", " ").replace(".", " ") + "]") for name in IDENTIFIERS]
    for t, (label, text) in enumerate([*TEMPLATES, *lines], len(BASE)):
        words, phrase, inside = text.split(), -1, False
        if len(words) > MOST_WORDS:
            raise ValueError(f"a template of {label} has over {MOST_WORDS} words")
        for i, word in enumerate(words):
            phrase, inside = phrase + word.startswith("["), inside or word.startswith("[")
            bare = word.strip("[]")
            if inside or len(bare) >= LETTERS:
                out.append((t, label, False, i, bare, phrase if inside else -1))
            inside = inside and not word.endswith("]")
    return out


def _index(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The postings (template, at, word), and of each template its label, base, indexed words as bits, and key phrases as bits."""
    rows = templates()
    kinds: dict[int, dict] = {}
    for t, label, base, at, _word, phrase in rows:
        own = kinds.setdefault(t, {"template": t, "label": label, "base": base, "every": 0, "phrases": {}})
        own["every"] |= 1 << at
        if phrase >= 0:
            own["phrases"][phrase] = own["phrases"].get(phrase, 0) | 1 << at
    listed = json.dumps([{"template": t, "at": at, "word": word} for t, _, _, at, word, _ in rows])
    told = json.dumps([{**own, "phrases": list(own["phrases"].values())} for own in kinds.values()])
    inline = lambda text, kind: spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))
    return inline(listed, "template:int,at:int,word:string"), inline(told, "template:int,label:string,base:boolean,every:bigint,phrases:array<bigint>")


def _rarest(frequency: dict[str, int]) -> list[tuple[str, int]]:
    """(word, template): each template's highest-IDF word of its key phrases, highest IDF first."""
    by: dict[int, set[str]] = {}
    for t, _label, _base, _at, word, phrase in templates():
        if phrase >= 0:
            by.setdefault(t, set()).add(word)
    found = [(min(words, key=lambda w: (frequency.get(w, 0), w)), t) for t, words in by.items()]
    return sorted(found, key=lambda x: (frequency.get(x[0], 0), x))


def _words(text: Column) -> Column:
    """The parts of a text between separators; the first and the last one may be empty."""
    return F.split(F.translate(text, _UPPER, _LOWER), _APART)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of ``docs``."""
    spark = docs.sparkSession
    vocabulary = sorted({r[4] for r in templates()})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("doc_id", F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("key2"), _words(F.col("text")).alias("parts"))
    lead = (F.element_at("parts", 1) == "").cast("int")
    n = F.size("parts") - lead - F.when(F.size("parts") > 1, (F.element_at("parts", -1) == "").cast("int")).otherwise(0)
    placed = F.filter(F.transform("parts", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))), lambda x: x.isNotNull())
    seen = written(own.select("doc_id", "key1", "key2", n.cast("long").alias("n_words"), lead.alias("lead"), placed.alias("placed")), "licence-words")
    present = F.array_distinct(F.transform("placed", lambda x: x["word"]))
    # one count for each word of the fixed vocabulary
    counts = {r["word"]: r["count"] for r in seen.select(F.explode(present).alias("word")).groupBy("word").count().collect()}
    index, kinds = _index(spark)
    by_word: dict[str, list[int]] = {}
    for word, template in _rarest(counts):
        by_word.setdefault(word, []).append(template)
    lookups = F.create_map(*(x for w, found in by_word.items() for x in (F.lit(w), F.array(*map(F.lit, found)))))
    rare = F.array_intersect(F.transform("placed", lambda x: x["word"]), F.array(*map(F.lit, by_word)))  # one pass over a file's words
    looked = seen.withColumn("candidates", F.flatten(F.transform(rare, lambda w: F.element_at(lookups, w))))
    some = looked.filter(F.size("candidates") > 0).select("key1", "key2", "lead", "candidates", F.explode("placed").alias("p"))
    votes = some.select("key1", "key2", "candidates", (F.col("p.pos") - F.col("lead")).alias("pos"), F.col("p.word").alias("word")).join(F.broadcast(index), "word").filter(F.array_contains("candidates", F.col("template")))
    votes = votes.select("key1", "key2", "template", (F.col("pos") - F.col("at")).alias("start"), F.expr("shiftleft(1L, at)").alias("bit"))
    exact = votes.groupBy("key1", "key2", "template", "start").agg(F.bit_or("bit").alias("bits")).join(F.broadcast(kinds), "template")
    whole = F.transform("phrases", lambda mask, i: F.when(F.col("bits").bitwiseAND(mask) == mask, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    exact = exact.withColumns({"key_bits": F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x), "base_place": F.when(F.col("base") & (F.col("bits") == F.col("every")), F.col("start"))})
    # two grids of windows, one half a window further: starts up to DRIFT apart share a window of one of them
    grids = F.explode(F.array(*(F.struct(F.lit(g).alias("grid"), F.floor((F.col("start") + g * DRIFT) / (2 * DRIFT)).alias("window")) for g in (0, 1))))
    windows = exact.select("*", grids.alias("g")).groupBy("key1", "key2", "template", "label", "base", "every", F.size("phrases").alias("n_phrases"), "g").agg(
        F.bit_count(F.bit_or("bits")).alias("agreed"), F.bit_count(F.bit_or("key_bits")).alias("agreed_keys"),
        F.count(F.when(F.col("g.grid") == 0, F.col("base_place"))).alias("n_base"), F.min("base_place").alias("first"), F.max("base_place").alias("last"),
    )
    coverage = F.col("agreed") / F.bit_count("every")
    fits = F.when(F.col("base"), F.col("first").isNotNull()).otherwise((coverage >= COVERAGE) & (F.col("agreed_keys") == F.col("n_phrases")))
    found = windows.groupBy("key1", "key2").agg(
        F.sum("n_base").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base") & F.col("first").isNotNull(), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(fits, F.col("label")))).alias("labels"),
        F.max(F.when(fits, 0.5 + 0.5 * coverage).otherwise(0.5 * coverage)).alias("score"),
    )
    found = written(found, "licences")
    return seen.select("doc_id", "key1", "key2", "n_words").join(found, ["key1", "key2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
