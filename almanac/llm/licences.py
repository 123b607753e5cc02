"""Licence notices by diagonal voting of word k-grams.

All k-grams of a document's words are joined with the k-grams of the templates.  A hit at word i of
the document and word p of the template votes for the diagonal i - p.  Votes are summed by diagonal,
neighbouring diagonals (a word more or less) are merged, and a span counts where enough of the
template's k-grams were found inside a span of about the template's length.

Everything runs on column functions.  Texts are scanned twice, hits are few and are all that is
shuffled besides ids and counts.

Defined results: a null text is empty; a text without words has 0 words, no labels and score 0; rows
with equal id and text are scanned each for itself and get equal results; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, lower_ascii, text_of

#: The words of a text, the phrases that always count and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices, as (label, text).
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def grams(ws: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; empty for shorter texts."""
    at = F.sequence(F.lit(0), F.size(ws) - k)
    return F.when(F.size(ws) >= k, F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def templates(spark, notices: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, grams, gram, p): a fixed table, as many rows as the notices have words."""
    t = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(notices)], "template int, label string, text string")
    t = t.withColumn("g", let(words(F.col("text")), lambda w: grams(w, k)))
    return t.select("template", "label", F.size("g").alias("grams"), F.posexplode("g").alias("p", "gram"))


def phrase_starts(ws: Column, phrase: str) -> Column:
    """Word positions where the phrase's words stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        # The last word is the rarest of the phrases here; it is looked at first.
        cond = F.get(ws, i + len(parts) - 1) == parts[-1]
        for j, w in enumerate(parts[:-1]):
            cond = cond & (F.get(ws, i + j) == w)
        return cond

    return F.when(F.size(ws) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(ws) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def spans(docs: DataFrame, keys: Sequence[str], text: Column, notices: Sequence[tuple[str, str]] = NOTICES, k: int = 3, slack: int = 2) -> DataFrame:
    """Merged diagonals: keys, template, label, first_word, last_word, coverage (share of the template's k-grams found).

    Votes of a diagonal are the set of its template positions, at most the template's length, so a
    repeated row adds nothing.  Diagonals at most ``slack`` apart are one span.
    """
    spark = docs.sparkSession
    t = F.broadcast(templates(spark, notices, k))  # fixed size
    g = docs.select(*keys, F.posexplode(let(words(text), lambda w: grams(w, k))).alias("i", "gram"))
    hits = g.join(t, "gram").select(*keys, "template", "label", "grams", "p", (F.col("i") - F.col("p")).alias("diagonal"))
    votes = hits.groupBy(*keys, "template", "label", "grams", "diagonal").agg(F.collect_set("p").alias("ps"))
    # One document's diagonals of one template; a document is one row, so this is bounded by its length.
    w = Window.partitionBy(*keys, "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int")
    votes = votes.withColumn("band", F.sum(F.coalesce(new, F.lit(0))).over(w))
    band = votes.groupBy(*keys, "template", "label", "grams", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ps")))).alias("found"),
        F.min(F.col("diagonal") + F.array_min("ps")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("ps") + (k - 1)).alias("last_word"),
    )
    return band.withColumn("coverage", F.col("found") / F.col("grams"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: Sequence[tuple[str, str]] = NOTICES, phrases: Mapping[str, str] = PHRASES, k: int = 3, at_least: float = 0.7) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are those of ``phrases``.  A span adds its label where it holds ``at_least`` of its
    template's k-grams and is no longer than one and a half templates.  The score is 1 with a base
    place, else the largest coverage of a span.
    """
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_h"))
    found = spans(keyed, ["doc_id", "_h"], F.col("_text"), notices, k)
    good = (F.col("coverage") >= at_least) & (F.col("last_word") - F.col("first_word") + 1 <= 1.5 * (F.col("grams") + k - 1))
    found = found.groupBy("doc_id", "_h").agg(F.collect_set(F.when(good, F.col("label"))).alias("_labels"), F.max("coverage").alias("_cover"))
    found = found.withColumnsRenamed({"doc_id": "_id", "_h": "_hh"})
    any_ = text.rlike("(?i)license")
    none = F.array().cast("array<int>")

    def parts(w: Column) -> Column:
        # Phrases that end in "license" are looked for only in texts that hold the word.
        at = [F.when(any_, phrase_starts(w, p)).otherwise(none) if p.endswith("license") else phrase_starts(w, p) for p in phrases]
        return F.struct(F.size(w).alias("n"), *[c.alias(f"p{n}") for n, c in enumerate(at)])

    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_h"), let(words(text), parts).alias("_x"))
    base = base.select("doc_id", "_h", F.col("_x.n").cast("long").alias("n_words"), *[F.col(f"_x.p{n}").alias(f"_p{n}") for n in range(len(phrases))])
    places = F.concat(*[F.col(f"_p{n}") for n in range(len(phrases))])
    kinds = F.array_compact(F.array(*[F.when(F.size(f"_p{n}") > 0, F.lit(label)) for n, label in enumerate(phrases.values())]))
    base = base.select("doc_id", "_h", "n_words", places.alias("_at"), F.array_sort(F.array_distinct(kinds)).alias("_base"))
    base = base.select("doc_id", "_h", "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"), "_base")
    out = base.join(found, base.doc_id.eqNullSafe(found._id) & (base._h == found._hh), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_cover", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def scan_sql(notices: Sequence[tuple[str, str]] = NOTICES, slack: int = 2, at_least: float = 0.7) -> str:
    """The scan with k = 3 as one SQL query over ``documents`` with distinct ids."""
    values = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, text) in enumerate(notices))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {word})"
    nth = lambda by: f"a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c, i FROM {by} WINDOW w AS (PARTITION BY key ORDER BY i)"
    match = {p: " AND ".join(f"{x} = '{w}'" for x, w in zip("abc", p.split())) for p in PHRASES}
    any_of = " OR ".join(f"({m})" for m in match.values())
    label = "CASE " + " ".join(f"WHEN {match[p]} THEN '{x}'" for p, x in PHRASES.items()) + " END"
    return f"""
WITH d AS (SELECT doc_id AS key, {low("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT key, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM d),
n AS (SELECT key, {nth("u")}),
p AS (SELECT key, i, {label} AS label FROM n WHERE {any_of}),
b AS (SELECT key, count(*) AS n, min(i) AS f, max(i) AS l, list_sort(list(DISTINCT label)) AS base FROM p GROUP BY 1),
t0 AS (SELECT template AS key, label, {low("text")} AS w FROM (VALUES {values}) v(template, label, text)),
t1 AS (SELECT key, label, len(w) - 2 AS grams, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM t0),
t AS (SELECT key AS template, label, grams, {nth("t1")}),
h AS (SELECT n.key, template, label, grams, t.i AS p, n.i - t.i AS diagonal FROM n JOIN t USING (a, b, c)),
v AS (SELECT key, template, label, grams, diagonal, list(p) AS ps, min(p) AS lo, max(p) AS hi FROM h GROUP BY ALL),
s0 AS (SELECT *, CAST(coalesce(diagonal - lag(diagonal) OVER (PARTITION BY key, template ORDER BY diagonal) > {slack}, false) AS INTEGER) AS new FROM v),
s1 AS (SELECT *, sum(new) OVER (PARTITION BY key, template ORDER BY diagonal) AS band FROM s0),
s AS (SELECT key, label, grams, len(list_distinct(flatten(list(ps)))) AS found, min(diagonal + lo) AS f, max(diagonal + hi + 2) AS l FROM s1 GROUP BY key, template, label, grams, band),
e AS (SELECT key, list(DISTINCT label) FILTER (WHERE CAST(found AS DOUBLE) / grams >= {at_least}::DOUBLE AND l - f + 1 <= 1.5 * (grams + 2)) AS more, max(CAST(found AS DOUBLE) / grams) AS cover FROM s GROUP BY 1)
SELECT d.key AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(b.f AS BIGINT) AS first_word, CAST(b.l AS BIGINT) AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(cover, 0) END AS score
FROM d LEFT JOIN b ON b.key = d.key LEFT JOIN e ON e.key = d.key
"""
