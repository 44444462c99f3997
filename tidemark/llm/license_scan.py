"""License scans: a positional rare-token index.

Built from DataFrame functions only; each text is scanned within its row and nothing is shuffled. Templates are
turned into postings: word, template, position. A word's IDF is the logarithm of the templates over those that
have it; words of ``MIN_IDF`` or more, but for common ones, are the index, and every one of them in a text is
looked up, so that neither long texts nor several notices lose votes. Each occurrence and each posting of its word vote for a template at a relative position (place in the
text less place in the template); a template's best position must reach ``MIN_SHARE`` of the votes that it can
get, and its mandatory phrases must be in the text. Votes are counted by sorting, in time that follows their number.

Base phrases are looked up at their rarest word and compared word by word.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_IDF, MIN_SHARE = 1.0, 0.7

# Words of any English text, which are no licence words however few templates have them.
COMMON = frozenset("a an and any are as at be by can except for free from has have hereby if in into is it law may met no not of on or other out possible provided subject such than that the their this to under up us use was were will with without work you your".split())

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Licence notices as their stewards ask to have them put, in words of the scan, and the phrases that must be there.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "except in compliance")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("gpl-2", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2")),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3")),
    ("epl-2", "made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    ("eupl", "licensed under the eupl version 1 2", ("licensed under the eupl",)),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)


def build_index(templates=TEMPLATES, min_idf: float = MIN_IDF) -> tuple[dict[str, list[tuple[int, int]]], dict[str, float], list[int]]:
    """Postings and IDF of the indexed words, and how many votes each template can get."""
    words = [t[1].split() for t in templates]
    idf = {w: math.log(len(templates) / sum(w in t for t in words)) for t in words for w in t if w not in COMMON}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(words):
        for at, w in enumerate(own):
            if idf.get(w, 0) >= min_idf:
                postings.setdefault(w, []).append((t, at))
    return dict(sorted(postings.items())), {w: idf[w] for w in sorted(postings)}, [sum(p[0] == t for ps in postings.values() for p in ps) for t in range(len(templates))]


def _map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased and nothing else."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def scan(docs: DataFrame, templates=TEMPLATES, base=None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score, which replace columns so named.

    n_base counts all places of all base phrases, first_word and last_word are the smallest and largest (null
    without any). labels has the base labels and those of templates found. score is the largest share of votes
    of a template found, 1 for a base phrase, else 0.

    * A null text counts as empty: no words, no labels, score 0. Repeated rows are scanned alike.
    * Occurrences that overlap all count. Of templates with the same label the best counts; ties change nothing, as
      only the number of votes and no position is returned.
    * Very long texts are scanned whole; the row holds the words and a vote for each licence word among them.
    * Other columns stay as they are; an empty table stays empty.
    """
    base = BASE if base is None else base
    postings, idf, most = build_index(templates)
    phrases = {p: p.split() for p in base}
    rarest = {p: max(range(len(w)), key=lambda k: (idf.get(w[k], 0.0), -k)) for p, w in phrases.items()}
    looked_up = sorted({*postings, *(w[rarest[p]] for p, w in phrases.items())})
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [F.col(c) for c in docs.columns if c not in added]

    rows = docs.select(F.struct(*kept).alias("_row"), words_of(F.col("text")).alias("w"))
    at = F.transform("w", lambda w, i: F.when(w.isin(looked_up), F.struct(i.alias("at"), w.alias("w"))))
    rows = rows.withColumn("hits", F.array_compact(at))

    def places(phrase: str) -> Column:
        own, k = phrases[phrase], rarest[phrase]
        start = F.transform(F.filter("hits", lambda h: h["w"] == own[k]), lambda h: h["at"] - k)
        return F.filter(start, lambda s: (s >= 0) & reduce(lambda a, b: a & b, [F.coalesce(F.get(F.col("w"), s + j) == x, F.lit(False)) for j, x in enumerate(own)]))

    none = F.array().cast("array<int>")
    rows = rows.withColumn("found", F.when(F.size("hits") > 0, F.array(*[places(p) for p in base])).otherwise(F.array(*[none] * len(base))))

    # The votes of the postings of every licence word in the text.
    lists = _map({w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in ps]) for w, ps in postings.items()})
    votes = F.flatten(F.transform(F.filter("hits", lambda h: h["w"].isin(list(idf))), lambda h: F.transform(F.element_at(lists, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["at"] - p["q"]).alias("d")))))
    rows = rows.withColumn("votes", F.when(F.size("hits") > 0, F.array_sort(votes)))

    def best(t: int) -> Column:
        """Votes for the best relative position: the longest run among the sorted ones."""
        own = F.transform(F.filter("votes", lambda v: v["t"] == t), lambda v: v["d"])
        start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, d: Column) -> Column:
            run = F.when(acc["last"] == d, acc["run"] + 1).otherwise(F.lit(1))
            return F.struct(d.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(own, start, step, lambda acc: acc["best"])

    said = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    verified = []
    for t, (label, _, mandatory) in enumerate(templates):
        share = F.least(F.lit(1.0), F.col("best")[t] / F.lit(float(max(1, most[t]))))
        there = reduce(lambda a, b: a & b, [F.contains("said", F.lit(f" {p} ")) for p in mandatory])
        verified.append(F.when((share >= MIN_SHARE) & there, F.struct(F.lit(label).alias("label"), share.alias("share"))))
    rows = rows.withColumn("best", F.when(F.size("votes") > 0, F.array(*[best(t) for t in range(len(templates))])))
    near = F.exists("best", lambda x: x > 0)
    rows = rows.withColumn("said", F.when(near, said))
    rows = rows.withColumn("by_template", F.coalesce(F.array_compact(F.array(*verified)), F.array()))

    names = list(base.values())
    of_base = F.array_compact(F.array(*[F.when(F.size(F.col("found")[k]) > 0, F.lit(names[k])) for k in range(len(names))]))
    starts = F.flatten("found")
    labels = F.array_union(of_base, F.transform("by_template", lambda x: x["label"]))
    score = F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("by_template", lambda x: x["share"])), F.lit(0.0)))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        "_row.*",
        F.size("w").cast("long").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(labels).alias("labels"),
        score.alias("score"),
    )

