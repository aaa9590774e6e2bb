"""License scan as an exact set-similarity join, in DataFrame functions only.

Texts are joined with license notices: a text holds a notice when a stretch of
at most ``SPREAD`` times the notice's length in consecutive words, over line
ends, holds at least ``CONTAINMENT`` of the notice's distinct words. The blocks
of the join are windows of two stretches that start one stretch apart, so that
every stretch lies in one window; a text that as a whole lacks the words of all
notices of a length is not cut for it. The join is exact and never looks at
pairs without a shared rare word:

* words are ordered by the number of texts that hold them (only words of
  notices are counted), rarest first;
* prefix filter: a notice of n words that needs k of them is indexed under its
  n - k + 1 rarest words only; a matching block has at least one of these;
* length filter: the block has at least k words;
* positional filter: when the first shared word is the notice's p-th and the
  q-th of the block's notice words, at most min(n - p, |block| - q) words can be
  shared, which must reach k;
* what is left is verified on the full word sets of the block, then of each
  stretch in it.

The base scan is the same join at containment 1 with the whole text as block,
its verification being that the phrase's words stand consecutively.

Words are runs of characters other than ASCII non-alphanumerics, A-Z folded to
a-z. Defined results: null and empty texts have no words and no labels (empty
strings, null positions, score 0); rows that share a doc_id (also null) are one
document for the notice labels; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, safe_text, small_side

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices (public license wording) and the labels they add.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
CONTAINMENT = 0.9
# A notice's words stand within this many times its length.
SPREAD = 2

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def stretch_of(notice: str) -> int:
    return SPREAD * len(notice.split())


def need_of(notice: str, containment: float) -> int:
    return math.ceil(containment * len(set(notice.split())) - 1e-9)


def blocks(table: DataFrame, notices, containment: float) -> DataFrame:
    """The windows of every text that may hold a notice: doc_id, stretch, block
    (number of the window), words. One set of windows for each length of the
    notices whose words the whole text holds."""
    vocabulary = sorted({w for t, _ in notices for w in t.split()})
    table = table.select("doc_id", "words", F.array_intersect(_strings(vocabulary), "words").alias("known"))
    held = {}
    for t, _ in notices:
        enough = F.size(F.array_intersect("known", _strings(sorted(set(t.split()))))) >= need_of(t, containment)
        held[stretch_of(t)] = held.get(stretch_of(t), F.lit(False)) | enough
    wanted = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in sorted(held.items())]))
    # Outer generators: Catalyst infers a filter for the others and pushes it,
    # with the tokenisation, into the scan.
    table = table.select("doc_id", "words", F.explode_outer(wanted).alias("stretch")).where("stretch is not null")
    windows = F.expr("transform(sequence(0, greatest(cast(ceil(size(words) / stretch) as int) - 2, 0)),"
                     " i -> slice(words, i * stretch + 1, 2 * stretch))")
    return table.select("doc_id", "stretch", F.posexplode_outer(windows).alias("block", "words"))


def word_order(table: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of texts that hold a word, rarest first.
    Counts cover all texts; at most one row per notice word is collected."""
    counted = (table.select(F.explode(F.array_intersect(_strings(vocabulary), "words")).alias("word"))
               .groupBy("word").count().collect())
    df = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (df.get(w, 0), w))


def notice_matches(docs: DataFrame, notices=None, containment: float = CONTAINMENT) -> DataFrame:
    """Every (doc_id, stretch, block, notice, label, overlap, containment) at or
    above the threshold, overlap being that of the block's best stretch;
    ``notices`` is a list of (words, label)."""
    spark = docs.sparkSession
    notices = NOTICES if notices is None else notices
    texts = docs.select("doc_id", words_of(safe_text()).alias("words"))
    order = word_order(texts, sorted({w for t, _ in notices for w in t.split()}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, (text, label) in enumerate(notices):
        ws = sorted(set(text.split()), key=rank.get)
        need = need_of(text, containment)
        index += [(w, stretch_of(text), k, label, p, need, ws) for p, w in enumerate(ws[:len(ws) - need + 1])]
    schema = "word string, stretch int, notice int, label string, p int, need int, notice_words array<string>"
    indexed = F.broadcast(spark.createDataFrame(index, schema))  # a few rows per notice
    prefix_words = sorted({r[0] for r in index}, key=rank.get)
    # The block's notice words in global order: array_intersect keeps the
    # order of its first argument.
    held = blocks(texts, notices, containment).select(
        "doc_id", "stretch", "block", "words", F.array_intersect(_strings(order), "words").alias("known"))
    probes = held.withColumn("word", F.explode(F.array_intersect("known", _strings(prefix_words))))
    pairs = probes.join(indexed, ["word", "stretch"]).where(F.size("words") >= F.col("need"))
    q = F.array_position("known", F.col("word")) - 1
    pairs = pairs.withColumn("reach", F.least(F.size("notice_words") - F.col("p"), F.size("known") - q))
    pairs = pairs.where("reach >= need").where(F.size(F.array_intersect("notice_words", "known")) >= F.col("need"))
    best = F.expr("array_max(transform(sequence(1, greatest(size(words) - stretch + 1, 1)),"
                  " i -> size(array_intersect(notice_words, slice(words, i, stretch)))))")
    pairs = pairs.withColumn("overlap", best)
    # A pair may be found under several prefix words; all rows are equal.
    return (pairs.where("overlap >= need")
            .groupBy("doc_id", "stretch", "block", "notice", "label")
            .agg(F.max("overlap").alias("overlap"), F.max(F.col("overlap") / F.size("notice_words")).alias("containment")))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def base_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the places of the base phrases: an array of
    (start, label), found only where the text has all words of a phrase."""
    vocabulary = sorted({w for p in PHRASES for w in p.split()})
    table = docs.select("doc_id", words_of(safe_text()).alias("words"))
    known = F.array_intersect(_strings(vocabulary), "words")
    found = []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        complete = F.size(F.array_intersect(known, _strings(ws))) == len(ws)
        starts = F.expr("filter(transform(words, (w, i) -> if(" + " and ".join(
            [f"w = '{ws[0]}'"] + [f"try_element_at(words, i + {k + 1}) = '{w}'" for k, w in enumerate(ws) if k]) + ", i, null)), i -> i is not null)")
        found.append(F.when(complete, _labelled(starts, label)).otherwise(F.array().cast("array<struct<start:int,label:string>>")))
    return table.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.concat(*found).alias("places"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    base = base_scan(docs)
    notes = (notice_matches(docs).groupBy("doc_id")
             .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
             .withColumnRenamed("doc_id", "note_id"))
    notes = small_side(cut(notes), 160)
    out = base.join(notes, F.col("doc_id").eqNullSafe(F.col("note_id")), "left")
    names = F.col("places")["label"]
    starts = F.col("places")["start"]
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
