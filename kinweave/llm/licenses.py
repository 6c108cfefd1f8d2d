"""License scans by diagonal voting.

The hashes of all runs of k words of every text are joined with the positions of those runs in the templates. A match
lies on the diagonal of its offset; the template positions met on a diagonal are its votes. Neighbouring diagonals are
merged, which bridges inserted and missing words, and a span stands if it meets enough of its template's runs. Every
match is verified by its words before it votes, so a span never rests on a collision of hashes. Phrases vote with runs
of two words, and must be met in full; license texts vote with runs of LONG_RUN words.

Only A-Z are lower-cased.

Defined cases: null texts are empty, have no words, and null first and last places; repeated rows give repeated rows;
a null doc_id is a key like any other; an empty table gives an empty result; other columns are ignored.

Scale: the templates are a constant of about RUNS runs, and so may be broadcast. Only matches are shuffled, grouped by
document and diagonal; a text of any length adds one row for each diagonal on which it meets a template.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import prepare, text_or_empty

SHORT_RUN, LONG_RUN = 2, 4
#: Merged diagonals are at most GAP apart; a span of a license text meets at least COVER of its runs.
GAP, COVER = 3, 0.6
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Phrases that stand in full, and their labels.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
#: Passages of public licenses and notices that name them.
TEXTS = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Released under the MIT License", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "apache-2.0"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


TEMPLATES = [(words_of(t), label, SHORT_RUN) for t, label in PHRASES] + [(words_of(t), label, LONG_RUN) for t, label in TEXTS]
RUNS = sum(len(w) - k + 1 for w, _, k in TEMPLATES)


def template_runs(spark: SparkSession) -> DataFrame:
    """(k, run, template, at): every run of k words of the templates; template -1 is met once by each row."""
    rows = [(k, " ".join(w[i : i + k]), t, i) for t, (w, _, k) in enumerate(TEMPLATES) for i in range(len(w) - k + 1)]
    return spark.createDataFrame([*rows, (0, "", -1, 0)], "k int, run string, template int, at int")


def matches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, template, diagonal, votes, copies), with a row of template -1 for each document."""
    prepare(docs.sparkSession)
    content = text_or_empty(text)
    found_words = F.regexp_extract_all(F.translate(content, string.ascii_uppercase, string.ascii_lowercase), F.lit(f"({WORD})"), F.lit(1))

    def hashes(words, k: int):
        n = F.size(words) - (k - 1)
        places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]).alias("h")))

    mark = F.array(F.struct(F.lit(0).alias("k"), F.lit(0).alias("i"), F.xxhash64(F.lit(0)).alias("h")))
    # the words are bound once, as a lambda's variable; a projection would be inlined into each hash
    bound = F.transform(F.array(found_words), lambda w: F.struct(w.alias("words"), F.concat(mark, *[hashes(w, k) for k in (SHORT_RUN, LONG_RUN)]).alias("hashes")))
    words = docs.select("doc_id", F.xxhash64(content).alias("text_hash"), F.inline(bound))
    placed = words.select("doc_id", "text_hash", "words", F.inline("hashes"))
    runs = template_runs(docs.sparkSession)
    parts = F.split("run", " ")
    hashed = F.when(F.col("k") == 0, F.xxhash64(F.lit(0)))
    for k in (SHORT_RUN, LONG_RUN):
        hashed = hashed.when(F.col("k") == k, F.xxhash64(F.lit(k), *[F.get(parts, F.lit(j)) for j in range(k)]))
    runs = runs.select(F.col("k").alias("tk"), hashed.alias("th"), "run", "template", "at")
    met = placed.join(F.broadcast(runs), F.col("h") == F.col("th")).where("k = tk")
    met = met.where((F.col("k") == 0) | (F.array_join(F.slice("words", F.col("i") + 1, F.greatest("k", F.lit(1))), " ") == F.col("run")))
    found = met.select("doc_id", "text_hash", F.size("words").alias("n_words"), "template", (F.col("i") - F.col("at")).alias("diagonal"), "at")
    return found.groupBy("doc_id", "text_hash", "n_words", "template", "diagonal").agg(F.collect_set("at").alias("votes"), F.count("*").alias("copies"))


def spans(found: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word, share of runs met) from (template, diagonal, votes) of one text."""
    out = []
    by: dict[int, list[tuple[int, set[int]]]] = {}
    for template, diagonal, votes in found:
        if template >= 0:
            by.setdefault(template, []).append((diagonal, set(votes)))
    for template, diagonals in by.items():
        words, _, k = TEMPLATES[template]
        runs = len(words) - k + 1
        groups: list[list[tuple[int, set[int]]]] = []
        for d, votes in sorted(diagonals):
            if groups and k == LONG_RUN and d - groups[-1][-1][0] <= GAP:
                groups[-1].append((d, votes))
            else:
                groups.append([(d, votes)])
        for group in groups:
            met = set.union(*(v for _, v in group))
            share = len(met) / runs
            if share >= (COVER if k == LONG_RUN else 1.0):
                out.append((template, min(d + min(v) for d, v in group), max(d + max(v) for d, v in group) + k - 1, share))
    return sorted(out)


SCAN = "struct<spans:array<struct<label:string,first_word:long,last_word:long,share:double,base:boolean>>>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, and spans with label, first_word, last_word, share and base."""
    per = matches(docs, text).groupBy("doc_id", "text_hash", "n_words").agg(
        F.collect_list(F.struct("template", "diagonal", "votes")).alias("found"), F.max(F.when(F.col("template") == -1, F.col("copies"))).alias("copies")
    )

    @pandas_udf(SCAN)
    def merged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [spans([(x["template"], x["diagonal"], list(x["votes"])) for x in found]) if len(found) > 1 else [] for found in batch]
            yield pd.DataFrame({"spans": [[{"label": TEMPLATES[t][1], "first_word": a, "last_word": b, "share": s, "base": TEMPLATES[t][2] == SHORT_RUN} for t, a, b, s in row] for row in rows]})

    out = per.withColumn("spans", merged("found")["spans"])
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
