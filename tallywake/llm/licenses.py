"""License scan: base phrases, and an exact set-similarity join with templates.

Words are maximal runs of ASCII letters and digits and of all characters beyond
ASCII, ASCII letters in lower case. The base phrases are found at every place.
The method's own labels come from an exact join: a text block (a line) matches a
template if it holds at least ``THRESHOLD`` of the template's distinct words.

Template words are ordered by how many documents of the whole corpus hold them,
rarest first. If a block shares ``need`` words of a template of ``n``, it shares
one of the first ``n - need + 1`` (prefix filter), has ``need`` template words
itself (length filter), and from the first shared word on there are enough words
left on both sides (positional filter). The index of prefix words is as long as
the list of templates, a constant of this module, and is all that is broadcast.

Only DataFrame functions run. The text stays in its row; only matches are
grouped. Null and empty texts have no words, no labels and score 0. Rows that
repeat a doc_id are judged by their own text. Empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: Phrases and labels of the base.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices as they are commonly written, with their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright cc0 public domain dedication"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher"),
]
THRESHOLD = 0.8
#: A word, in text whose letters are not yet in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def need_of(n: int, threshold: float) -> int:
    """The least number of shared words that meets the threshold."""
    need = int(n * threshold)
    while need < n * threshold - 1e-9:
        need += 1
    return max(1, need)


def places(words: Column) -> Column:
    """(start, label) of every place of a base phrase, in ascending order."""

    def starts(parts: list[str]) -> Column:
        def here(i):
            out = F.get(words, i) == parts[0]
            for k, part in enumerate(parts[1:], 1):
                out = out & (F.get(words, i + k) == part)
            return out

        return F.filter(F.sequence(F.lit(0), F.size(words)), here)

    def marked(parts: list[str], label: str) -> Column:
        return F.transform(starts(parts), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.array_sort(F.concat(*(marked(phrase.split(), label) for phrase, label in sorted(PHRASES.items()))))


def orders(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the templates, over all documents;
    one row for each word of this module's templates comes to the driver."""
    held = F.array_intersect(words_of(F.lower("text")), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def block_matches(blocks: DataFrame, frequency: dict[str, int], templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """The join. ``blocks(key..., words)`` with distinct words of a block; the
    result has the other columns, template (its number), label and score."""
    templates = TEMPLATES if templates is None else templates
    spark = blocks.sparkSession
    rank = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w)))}
    index = []
    for k, (label, text) in enumerate(templates):
        own = sorted(set(text.split()), key=rank.get)
        need = need_of(len(own), threshold)
        index += [(w, k, label, i, need, own) for i, w in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(index, "word string, template int, label string, i int, need int, own array<string>")
    order = F.array(*map(F.lit, rank))  # in rank order, so that an intersection with it is in that order
    keys = [c for c in blocks.columns if c != "words"]
    ordered = blocks.withColumn("words", F.array_intersect(order, "words"))
    probe = ordered.select(*keys, "words", F.posexplode("words").alias("j", "word"))
    shared = F.size(F.array_intersect("own", "words"))
    left = F.least(F.size("own") - F.col("i"), F.size("words") - F.col("j"))
    return (
        probe.join(F.broadcast(index), "word")
        .where((F.size("words") >= F.col("need")) & (left >= F.col("need")) )
        .where(shared >= F.col("need"))
        .groupBy(*keys, "template", "label").agg(F.max(shared / F.size("own")).alias("score"))
    )


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``; see ``op5_licenses``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()})
    frequency = orders(docs, vocabulary)
    # A text without any prefix word or first word of a phrase cannot match.
    anchors = {p.split()[-1] for p in PHRASES} - {"by"} | {"cc"}
    for _, t in TEMPLATES:
        own = sorted(set(t.split()), key=lambda w: (frequency.get(w, 0), w))
        anchors |= set(own[: len(own) - need_of(len(own), threshold) + 1])
    anchor = F.array(*map(F.lit, sorted(anchors)))
    rows = docs.withColumn("any", words_of(F.lower("text"))).select(
        "doc_id", F.xxhash64("text").alias("h"), F.size("any").cast("long").alias("n_words"),
        ascii_lower(F.when(F.arrays_overlap("any", anchor), F.col("text"))).alias("text"),
    )
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = cut(rows.select("doc_id", "h", "n_words", F.split("text", "\n").alias("lines"), F.coalesce(F.when(F.col("words").isNotNull(), places(F.col("words"))), F.array()).alias("places")))
    blocks = rows.where("lines is not null").select("doc_id", "h", F.explode("lines").alias("line")).distinct().select("doc_id", "h", F.xxhash64("line").alias("b"), F.array_distinct(words_of(F.col("line"))).alias("words"))
    hits = block_matches(blocks, frequency, threshold=threshold)
    found = hits.groupBy("doc_id", "h").agg(F.collect_set("label").alias("own"), F.max("score").alias("best")).withColumnsRenamed({"doc_id": "d", "h": "g"})
    labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    starts = F.transform("places", lambda p: p["start"])
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same over whole tables: every block against every template."""
    kinds = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r})" for k, (label, t) in enumerate(TEMPLATES))
    at = " UNION ALL ".join(
        "SELECT row, label, i - 1 AS start FROM (SELECT row, '{}' AS label, words, unnest(generate_series(1, len(words))) AS i FROM d) WHERE {}".format(
            label, " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        )
        for phrase, label in sorted(PHRASES.items())
    )
    return rf"""
WITH t(template, label, own) AS (VALUES {kinds}),
c AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d AS (SELECT row, doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM c),
p AS (SELECT row, count(*) AS n, min(start) AS a, max(start) AS z, list_sort(list_distinct(list(label))) AS labels FROM ({at}) GROUP BY row),
b AS (SELECT row, regexp_extract_all(unnest(string_split(low, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
m AS (SELECT row, label, len(list_intersect(own, words)) / len(own) AS score FROM b, t WHERE len(list_intersect(own, words)) >= {THRESHOLD} * len(own) - 1e-9),
q AS (SELECT row, list_distinct(list(label)) AS labels, max(score) AS best FROM m GROUP BY row)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base, p.a AS first_word, p.z AS last_word,
  coalesce(array_to_string(p.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(q.labels, [])))), ',') AS labels,
  CASE WHEN p.n > 0 THEN 1.0 ELSE coalesce(q.best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p ON d.row = p.row LEFT JOIN q ON d.row = q.row
"""


SQL5 = _sql()
