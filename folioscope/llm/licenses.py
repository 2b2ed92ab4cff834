"""Operator 8: licence scans by a positional rare-token index, by DataFrame functions only.

1. Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. Templates are word sequences: short
   phrases, whose every occurrence counts, and passages of licences with mandatory key phrases. One scan normalises each
   text and writes its licence words (those that any template has) with their positions; nothing later reads the text.
2. Document frequencies of the licence words over all documents give each word's IDF.
3. The index holds, for each template, postings (word, template, position in it) of its words of the highest IDF: two of a
   phrase; of a passage so many that any start at which ``NOTICE_SHARE`` of its words agree shares two of them. Each
   file looks up its licence words there. A posting gives a relative start, the file's position minus the template's; starts
   that two postings of a template share are the intersection.
4. At such a start a phrase needs all its words; a passage needs NOTICE_SHARE of them, and each of its key phrases must
   stand somewhere in the file.

The index holds a few hundred postings, whatever the input. Work on a file is one pass over its words, one over its licence
words, and one for each start that is left.

Defined results: null text is empty; an empty text or one without words has no places and no labels; overlapping and
repeated places all count; repeated rows are each scanned; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored, table, text_or_empty

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases: every occurrence counts. Fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices: label, words, key phrases that must stand in the file.
NOTICES = (
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("binary forms", "without modification")),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("free of charge", "obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance", ("apache license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-sa", "licensed under a creative commons attribution share alike license", ("creative commons", "share alike")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("the authors be held liable",)),
    ("bsl-1", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("neighboring rights",)),
    ("ofl-1", "this font software is licensed under the sil open font license version 1 1", ("open font license",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial portions",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("must retain the above copyright notice",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", ("in the hope that it will be useful",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nd", "licensed under a creative commons attribution no derivatives license", ("creative commons", "no derivatives")),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("artistic-2", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies", "changing it is not allowed")),
    ("psf", "this license agreement is between the python software foundation and the individual or organization accessing and otherwise using this software", ("python software foundation",)),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ("european commission",)),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software", ("if you use the software you accept this license",)),
    ("odbl", "made available under the open database license any rights in individual contents of the database are licensed under the database contents license", ("open database license",)),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages", ("university of california",)),
)
NOTICE_SHARE = 0.75


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal(text: Column) -> Column:
    """The words, each with a space before and after it; one space where there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), _SEPARATORS, " ")


def templates() -> list[tuple[str, list[str], bool, list[str]]]:
    """(label, words, whole, key phrases)."""
    return [(label, p.split(), True, []) for p, label in PHRASES.items()] + [(label, t.split(), False, list(keys)) for label, t, keys in NOTICES]


def _vocabulary() -> list[str]:
    return sorted({w for _, t, _, keys in templates() for w in [*t, *(x for key in keys for x in key.split())]})


_ENTRY = "array<struct<w:string,i:int>>"


def licence_words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, entries: the licence words and their positions from 0, in order)."""
    rows = text_or_empty(docs.select("doc_id", "text")).select("doc_id", normal(F.col("text")).alias("norm"))
    vocabulary = _vocabulary()
    known = F.transform(F.split(F.trim("norm"), " "), lambda w, i: F.when(w.isin(*vocabulary), F.struct(w.alias("w"), i.alias("i"))))
    n_words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) - 1
    return rows.select("doc_id", n_words.cast("long").alias("n_words"), F.filter(known, lambda e: e.isNotNull()).cast(_ENTRY).alias("entries"))


def word_idf(files: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all files: one aggregate of as many rows as there are such words."""
    held = F.array_distinct(F.transform("entries", lambda e: e["w"]))
    # the empty word stands for the file itself
    counts = files.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    df = {r.word: r.df for r in counts.collect()}
    return {w: math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)) + 1 for w in _vocabulary()}


def needed(template: list[str], whole: bool) -> int:
    """How many words of a template must agree at a start."""
    return len(template) if whole else math.ceil(NOTICE_SHARE * len(template))


def postings(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """The index: word -> (template, position). Of a template its positions of the highest IDF, two more than may disagree."""
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, whole, _) in enumerate(templates()):
        rarest = sorted(range(len(words)), key=lambda k: (-idf[words[k]], k))
        for k in rarest[: len(words) - needed(words, whole) + 2]:
            found.setdefault(words[k], []).append((t, k))
    return found


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is reckoned once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _shared_starts(entries: Column, index: dict[str, list[tuple[int, int]]]) -> Column:
    """(t, s) of each template and start that two or more postings of the file's licence words share."""
    table_ = F.create_map(*[x for w, held in sorted(index.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in held]))])
    starts = lambda e: F.transform(F.try_element_at(table_, e["w"]), lambda p: F.struct(p["t"].alias("t"), (e["i"] - p["k"]).alias("s")))
    votes = F.array_sort(F.flatten(F.transform(F.filter(entries, lambda e: e["w"].isin(*sorted(index))), starts)))
    first = lambda v: lambda x, j: (F.get(v, j + 1) == x) & ((j == 0) | (F.get(v, j - 1) != x))
    return _bound(votes, lambda v: F.filter(v, first(v)))


def _stands(entries: Column, phrase: list[str]) -> Column:
    """Whether the phrase stands anywhere in the file: its words are licence words, so that they are neighbours there."""

    def at(e: Column, j: Column) -> Column:
        out = e["w"] == phrase[0]
        for m, word in enumerate(phrase[1:], 1):
            other = F.get(entries, j + m)
            out = out & (other["w"] == word) & (other["i"] == e["i"] + m)
        return F.coalesce(out, F.lit(False))

    return F.exists(F.transform(entries, at), lambda x: x)


def _confirmed(entries: Column, start: Column) -> Column:
    """Whether enough words of the template agree at the start, and its key phrases stand in the file."""
    every = templates()
    words = F.get(F.array(*[F.array(*map(F.lit, t)) for _, t, _, _ in every]), start["t"])
    least = F.get(F.array(*[F.lit(needed(t, whole)) for _, t, whole, _ in every]), start["t"])
    agree = F.size(F.filter(entries, lambda e: F.when(e["i"] >= start["s"], F.get(words, e["i"] - start["s"]) == e["w"])))
    keys = F.lit(True)
    for t, (_, _, _, phrases) in enumerate(every):
        if phrases:
            stand = F.lit(True)
            for phrase in phrases:
                stand = stand & _stands(entries, phrase.split())
            keys = F.when(start["t"] == t, stand).otherwise(keys)
    return F.when(agree >= least, keys).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, places array<struct<start, label>>, notices alike, base_labels, labels, score)."""
    files = stored(licence_words(docs), "licence-words")
    index = postings(word_idf(files))
    entries = F.col("entries")
    shared = files.select("doc_id", "n_words", "entries", _shared_starts(entries, index).alias("shared"))
    # most files share no start: theirs are not looked at again
    starts = F.when(F.size("shared") > 0, F.filter("shared", lambda x: _confirmed(entries, x)))
    found = shared.select("doc_id", "n_words", F.coalesce(starts, F.array().cast("array<struct<t:int,s:int>>")).alias("starts"))
    named = F.array(*[F.lit(label) for label, _, _, _ in templates()])
    place = lambda x: F.struct(x["s"].cast("long").alias("start"), F.get(named, x["t"]).alias("label"))
    of_kind = lambda whole: F.array_sort(F.transform(F.filter("starts", lambda x: (x["t"] < len(PHRASES)) == F.lit(whole)), place))
    found = found.select("doc_id", "n_words", of_kind(True).alias("places"), of_kind(False).alias("notices"))
    names = lambda c: F.transform(c, lambda p: p["label"])
    base_labels = F.array_sort(F.array_distinct(names("places")))
    labels = F.array_sort(F.array_distinct(F.concat(names("places"), names("notices"))))
    found = found.withColumn("base_labels", base_labels).withColumn("labels", labels)
    # the surer the more places there are: one half for the first, then half of what is left
    return found.withColumn("score", 1 - F.pow(F.lit(0.5), (F.size("places") + F.size("notices")).cast("double")))


def query(spark, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda p: p["start"])
    return s.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
