"""Licence scans: phrases word by word, and licence notices by an exact set-similarity join, in DataFrame operations only.

A text block is a line. A notice is found in a block when the block's set of words holds at least `percent` of the
notice's set (containment). The join meets only pairs that can be that similar:

* frequency order: the words of the notices are ordered by the number of blocks that hold them, rarest first;
* prefix filter: of a notice with n words, k of which are needed, a matching block holds one of its n - k + 1 rarest, so
  blocks meet notices by these words alone;
* length filter: a block with fewer words of the notices than any of them needs is left out before the join;
* positional filter: where the first common word is the i-th of the block and the j-th of the notice, at most
  1 + min(words after i, words after j) are common.

What is left is verified by the whole sets. Words that no notice has cannot add to an overlap, so blocks keep only the
others; the text is read once, in one projection, and does not travel.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower-cased: all of ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Common licence notices, (name, label, text).
TEMPLATES = [
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0-header", "apache", 'you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "mit", "Released under the MIT License"),
    ("mit-licensed", "mit", "Licensed under the MIT License"),
    ("mit-grant", "mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("bsd", "bsd", "Licensed under the BSD License"),
    ("bsd-grant", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-grant", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mpl-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-attribution", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("warranty", "disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("reserved", "reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission"),
]


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, SMALL))) if w]


def needed(n: int, percent: int) -> int:
    """The fewest common words of a notice with n different ones."""
    return -(-percent * n // 100)


def _literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(lower: Column, phrases: dict[str, str]) -> Column:
    """The struct (n_words, n_base, first_word, last_word, base_labels) of a lower-cased text. Phrases may overlap."""

    def measured(flat: Column) -> Column:  # " one two "
        n_words = F.when(F.length(flat) > 2, _spaces(flat) - 1).otherwise(0).cast("long")
        counts, first, last, labels = [], [], [], []
        for phrase, label in phrases.items():
            ws = words_of(phrase)
            here = f" {' '.join(ws)} "
            count = F.regexp_count(flat, F.lit(f"(?={re.escape(here)})")).cast("long")
            counts.append(count)
            first.append(F.when(count > 0, _spaces(F.substring_index(flat, here, 1)).cast("long")))
            last.append(F.when(count > 0, n_words - _spaces(F.substring_index(flat, here, -1)) - len(ws)))
            labels.append(F.when(count > 0, F.lit(label)))
        total = F.lit(0).cast("long")
        for c in counts:
            total = total + c
        return F.struct(
            n_words.alias("n_words"),
            total.alias("n_base"),
            F.array_min(F.array(*first)).alias("first_word"),
            F.array_max(F.array(*last)).alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base_labels"),
        )

    return let(F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, GAP, " ")), F.lit(" ")), measured)


def scanned(docs: DataFrame, phrases: dict[str, str], templates: list[tuple], percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, base, blocks) of each row, written once; blocks: (line, words of the notices), where enough for one of them."""
    sets = [set(words_of(text)) for _, _, text in templates]
    vocabulary, fewest = sorted(set().union(*sets)), min((needed(len(s), percent) for s in sets), default=1)
    texts = docs.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, SMALL).alias("lower"))
    held = lambda line, i: F.struct(i.alias("line"), F.array_intersect(F.split(line, GAP), _literals(vocabulary)).alias("words"))
    blocks = F.filter(F.transform(F.split(F.col("lower"), "\n"), held), lambda b: F.size(b["words"]) >= fewest)
    return durable(texts.select("id", F.monotonically_increasing_id().alias("row"), phrase_places(F.col("lower"), phrases).alias("base"), (blocks if vocabulary else F.array().cast("array<struct<line: int, words: array<string>>>")).alias("blocks")))


def matched(rows: DataFrame, templates: list[tuple], percent: int) -> DataFrame:
    """(row, id, line, template, label, overlap, containment) of every pair of a block of `scanned` and a notice that meets the threshold.

    What is gathered are the counts of the notices' words, a table of fixed size; the notices' prefixes are broadcast.
    """
    spark, schema = rows.sparkSession, "place int, j int, template string, label string, n int, need int, places array<int>"
    blocks = rows.select("id", "row", F.explode("blocks").alias("b")).select("id", "row", "b.line", "b.words")
    counts = {r["word"]: r["count"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").count().collect()}
    order = sorted(set().union(*[words_of(text) for _, _, text in templates]), key=lambda w: (counts.get(w, 0), w))
    place, prefixes = {w: k + 1 for k, w in enumerate(order)}, []
    for name, label, text in templates:
        places = sorted(place[w] for w in set(words_of(text)))
        need = needed(len(places), percent)
        prefixes += [(p, j, name, label, len(places), need, places) for j, p in enumerate(places[: len(places) - need + 1])]
    ordered = blocks.select("id", "row", "line", F.array_sort(F.transform("words", lambda w: F.array_position(_literals(order), w).cast("int"))).alias("held")) if order else blocks.select("id", "row", "line", F.array().cast("array<int>").alias("held"))
    met = ordered.select("*", F.posexplode("held").alias("i", "place")).join(F.broadcast(spark.createDataFrame(prefixes, schema)), "place")
    likely = met.where(F.least(F.size("held") - F.col("i"), F.col("n") - F.col("j")) >= F.col("need"))
    verified = likely.withColumn("overlap", F.size(F.array_intersect("held", "places"))).where("overlap >= need")
    return verified.select("row", "id", "line", "template", "label", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))


def license_blocks(docs: DataFrame, templates: list[tuple] = TEMPLATES, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, line, template, label, overlap, containment): every line, from 0, that holds a notice. Cases as in license_scan."""
    found = matched(scanned(docs, {}, templates, percent, id_col, text_col), templates, percent)
    kept = found.groupBy("row", "line", "template").agg(*[F.first(c).alias(c) for c in ("id", "label", "overlap", "containment")])
    return kept.select(F.col("id").alias(id_col), "line", "template", "label", "overlap", "containment")


def license_scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple] = TEMPLATES, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    n_base counts the places of all phrases, first_word and last_word are the smallest and largest of them, null where
    there is none; labels are those of phrases and of notices; score is 1 with a phrase, else the largest containment of
    a notice that meets the threshold, else 0; n_blocks counts pairs of a line and a notice. A null text is empty: no
    words, no labels, score 0. Null and repeated ids keep a row each; equal rows have equal results; other columns are
    ignored, whatever their names. Texts of any length are one row; no rows give no rows.
    """
    rows = scanned(docs, phrases, templates, percent, id_col, text_col)
    pairs = matched(rows, templates, percent)
    found = pairs.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most"), F.countDistinct("line", "template").alias("n_blocks"))
    base = F.col("base.base_labels")
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "base.n_words",
        "base.n_base",
        "base.first_word",
        "base.last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def scan_sql() -> str:
    """SQL for license_scan: every line against every notice."""
    lists = ", ".join(f"('{name}', '{label}', {words_of(text)!r}, {needed(len(set(words_of(text))), 90)})" for name, label, text in TEMPLATES)
    phrases = ", ".join(f"({words_of(p)!r}, '{label}')" for p, label in PHRASES.items())
    lower, split = f"translate(coalesce(text, ''), '{UPPER}', '{SMALL}')", r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH templates(template, label, words, need) AS (VALUES {lists}),
phrases(words, label) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS row, doc_id, {lower} AS lower FROM documents),
lines AS (SELECT row, unnest(string_split(lower, chr(10))) AS line, generate_subscripts(string_split(lower, chr(10)), 1) AS i FROM docs),
blocks AS (SELECT row, i, {split.format("line")} AS words FROM lines),
pairs AS (
  SELECT row, label, len(list_intersect(b.words, t.words)) AS common, len(list_distinct(t.words)) AS n, need
  FROM blocks b, templates t WHERE len(b.words) >= need),
found AS (
  SELECT row, list_distinct(list(label)) AS more, max(common / n) AS most, count(*) AS n_blocks FROM pairs WHERE common >= need GROUP BY row),
texts AS (SELECT row, doc_id, {split.format("lower")} AS words FROM docs),
places AS (
  SELECT row, label, p.i FROM (SELECT row, words, unnest(range(len(words))) AS i FROM texts) p, phrases f
  WHERE p.words[p.i + 1 : p.i + len(f.words)] = f.words),
base AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS known FROM places GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(known), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(known, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM texts LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""
