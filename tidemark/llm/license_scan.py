"""License scans with DataFrame functions only: fixed phrases, and a positional index of rare license words.

Base labels come from phrases whose words stand one after another. The method: how many documents hold each word of the
templates is counted over all documents. The index has postings (word, template, position) of the rare ones among them, and of
each template's `ANCHORS` rarest whatever their share. Each file looks up all of the index's words that it holds, those of highest
IDF first. Each place of such a word votes, with the word's IDF, for where a template would have to begin: votes that meet at
one place are the intersection of postings by relative position. A template whose votes reach `ACCEPT` of its anchors' weight
at a place, and whose mandatory phrases stand in the words from there to where it would end, gives its label. What leaves the
executors are one count for each template word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lower_ascii, split_words, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Label, template (words of a notice or of the license's own text), mandatory phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law", "without warranties or conditions of any kind")),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", ("each contributor hereby grants to you a perpetual",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl was not distributed",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "international license")),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal", ("waived all copyright",)),
)
#: Rarest words of a template, and the share of their weight that has to agree on one place.
ANCHORS, ACCEPT = 6, 0.75
#: Words in more than this share of the documents are postings only as anchors.
RARE = 0.05
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def words(text: Column) -> Column:
    return split_words(lower_ascii(text))


def spaced(phrase: str) -> str:
    """The phrase as it stands in a text whose words each have a space before and after them."""
    return " " + "  ".join(phrase.split()) + " "


def overlaps_itself(phrase: str) -> bool:
    w = phrase.split()
    return any(w[:i] == w[-i:] for i in range(1, len(w)))


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, int], int]:
    """How many documents hold each word of the vocabulary, and how many documents there are: over all of them."""
    held = docs.select(F.explode_outer(F.array_intersect(F.array(*map(F.lit, [*vocabulary, ""])), F.array_append(words(F.col(text)), F.lit("")))).alias("w"))  # "" counts the documents
    found = {r.w: r.n for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as words in the vocabulary
    return found, found.pop("", 0)


def postings(templates, counts: dict[str, int], total: int) -> list[tuple[str, float, list[tuple[int, int, float]]]]:
    """(word, IDF, [(template, position, weight)]) by falling IDF, then by word; the weights of a template's anchors add up to 1."""
    idf = {w: max(math.log((total + 1) / (counts.get(w, 0) + 0.5)), 1e-6) for _, body, _ in templates for w in body.split()}
    found: dict[str, list] = {}
    for t, (_, body, _) in enumerate(templates):
        ranked = sorted(((idf[w], -i, w) for i, w in enumerate(body.split())), reverse=True)
        whole = sum(x for x, _, _ in ranked[:ANCHORS])
        for place, (x, i, w) in enumerate(ranked):
            if place < ANCHORS or counts.get(w, 0) <= RARE * total:
                found.setdefault(w, []).append((t, -i, x / whole))
    return [(w, idf[w], found[w]) for w in sorted(found, key=lambda w: (-idf[w], w))]


def _words_in(spaced_text: Column) -> Column:
    """Words in a text of which each has one space before and one after it."""
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(" "), F.lit("")))) / 2).cast("long")


def scanned(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs with n_words, n_base (places of phrases), first_word and last_word (where the first and last of them begin, from 0;
    null without any), base_labels and labels (comma-joined), and score (0 to 1: the best agreement of any template at one place,
    1 with a phrase).

    A row out for each row in; null and empty texts have no words, empty labels and score 0. Columns with the names of the
    added ones are replaced. Phrases that can overlap themselves are refused.
    """
    if any(overlaps_itself(p) for p, _ in phrases):
        raise ValueError("a phrase whose end is also its beginning can't be counted by splitting")
    names = without(docs, ADDED).columns
    # The caller's columns go by other names on the way, so none can clash.
    df = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)), words(docs[f"`{text}`"]).alias("w"))
    df = df.withColumns({"n_words": F.size("w").cast("long"), "s": F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))})
    parts = {i: F.when(F.contains("s", F.lit(spaced(p))), F.split("s", spaced(p), -1)) for i, (p, _) in enumerate(phrases)}
    df = df.withColumns({f"p{i}": c for i, c in parts.items()})
    first = [_words_in(F.get(f"p{i}", F.lit(0))) for i in parts]
    last = [F.col("n_words") - _words_in(F.get(f"p{i}", F.size(f"p{i}") - 1)) - len(p.split()) for i, (p, _) in enumerate(phrases)]
    none = F.lit(None).cast("long")
    df = df.withColumns(
        {
            "n_base": sum((F.when(F.col(f"p{i}").isNull(), 0).otherwise(F.size(f"p{i}") - 1).cast("long") for i in parts), F.lit(0).cast("long")),
            "first_word": F.least(none, none, *first),
            "last_word": F.greatest(none, none, *last),
            "base": F.array_distinct(F.filter(F.array(F.lit(None).cast("string"), *(F.when(F.col(f"p{i}").isNotNull(), F.lit(label)) for i, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())),
        }
    )
    own, best = F.array().cast("array<string>"), F.lit(0.0)
    if templates:
        df = voted(df, postings(templates, *document_counts(docs, sorted({w for _, body, _ in templates for w in body.split()}), text)), templates)
        labels = F.array(*(F.lit(label) for label, _, _ in templates))
        own, best = F.transform("sum.found", lambda t: F.get(labels, t)), F.col("sum.best")
    return df.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), best)).alias("score"),
    )


def voted(df: DataFrame, index, templates) -> DataFrame:
    """df (w: words) with `sum`: `best`, the greatest agreement of any template at one place, and `found`, the templates that a place reaches
    whose words hold their phrases."""
    # What the file looks up, by falling IDF, the postings of each, and the places of each in the file.
    df = df.withColumn("top", F.array_intersect(F.array(*(F.lit(w) for w, _, _ in index)), F.col("w")))
    table = F.create_map(*(x for w, _, found in index for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i"), F.lit(v).alias("v")) for t, i, v in found)))))
    df = df.withColumn("posts", F.transform("top", lambda w: F.element_at(table, w)))
    df = df.withColumn("hits", F.filter(F.transform("w", lambda w, i: F.struct(F.array_position("top", w).cast("int").alias("of"), i.alias("i"))), lambda x: x["of"] > 0))
    votes = F.flatten(F.transform("hits", lambda h: F.transform(F.get("posts", h["of"] - 1), lambda p: F.struct(p.t.alias("t"), (h.i - p.i).alias("at"), p.v.alias("v")))))
    df = df.withColumn("votes", F.sort_array(votes))
    lengths = F.array(*(F.lit(len(body.split())) for _, body, _ in templates))
    phrases = F.array(*(F.array(*(F.lit(spaced(p)) for p in must)).cast("array<string>") for _, _, must in templates))

    def holds(t: Column, at: Column) -> Column:
        """Whether the words at which the template would stand hold its phrases; it may begin before the file does."""
        there = F.slice("w", F.greatest(at, F.lit(0)) + 1, F.greatest(F.get(lengths, t) + F.least(at, F.lit(0)), F.lit(0)))
        span = F.concat(F.lit(" "), F.array_join(there, "  "), F.lit(" "))
        return F.forall(F.get(phrases, t), lambda p: F.contains(span, p))

    def add(a: Column, v: Column) -> Column:
        total = F.when((a.t == v.t) & (a.at == v["at"]), a.sum + v.v).otherwise(v.v)
        reached = (total >= ACCEPT - 1e-9) & ~F.array_contains(a.found, v.t) & holds(v.t, v["at"])
        return F.struct(v.t.alias("t"), v["at"].alias("at"), total.alias("sum"), F.greatest(a.best, total).alias("best"), F.when(reached, F.array_append(a.found, v.t)).otherwise(a.found).alias("found"))

    start = F.struct(F.lit(-1).alias("t"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("found"))
    return df.withColumn("sum", F.aggregate("votes", start, add))
