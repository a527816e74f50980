"""Licence scan by diagonal voting, in DataFrame functions only.

Every rolling K-word hash of a text that is one of the templates' is joined with the places where the templates hold
it (a table of fixed size). The votes are summed by text, template and diagonal (word number in the text less that in
the template). Neighbouring diagonals, apart by at most GAP words that were put in or left out, are merged, and the
words of the span are compared with the template's. Of diagonals that begin at the same word of the template the first
in the text lends its words.

A base place is a diagonal of a base phrase with all its votes whose words are the phrase's. Null and empty texts have
no words and no labels. Only A-Z are lower-cased. Repeated rows each get their row; only the id and text columns are
read, under names of their own; an empty table gives an empty result. Spans are in the order of their labels, then their
places. A very long text is hashed in its row; only its hits, and two template lengths of words with each, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillsift.llm.common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, GAP = 3, 2
#: Share of a template's votes that a merged span needs, and share of its words that the span must hold.
MIN_VOTES, MIN_WORDS = 0.6, 0.75
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Notices beyond the base phrases, by label, in words as WORD finds them.
NOTICES = [
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
]


def templates(base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES) -> list[tuple[int, str, bool, list[str]]]:
    return [(n, label, n < len(base), words.split()) for n, (label, words) in enumerate([*base, *notices])]


def _hash(words, i):
    """Hash of the K words from place i, 0-based."""
    return F.xxhash64(*(F.get(words, i + j) for j in range(K)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list | None = None) -> DataFrame:
    """Verified spans and row totals: one row per document with `spans`, an array of (label, base, start, words, cover)."""
    spark = docs.sparkSession
    known = known or templates()
    longest = max(len(t[3]) for t in known)
    facts = spark.createDataFrame(known, "template int, label string, base boolean, phrase array<string>")
    at = F.explode(F.sequence(F.lit(0), F.size("phrase") - K))
    grams = facts.select("template", "phrase", at.alias("at")).select("template", "at", _hash(F.col("phrase"), F.col("at")).alias("hash"))
    listed = [r[0] for r in grams.select("hash").distinct().collect()]  # as many as the templates have

    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col(id_col).alias("id"), words.alias("words")).withColumn("row", F.monotonically_increasing_id())
    n = F.size("words")
    hits = F.when(n >= K, F.filter(F.sequence(F.lit(0), n - K), lambda i: _hash(F.col("words"), i).isin(listed))).otherwise(F.array().cast("array<int>"))
    near = lambda i: F.struct(i.alias("place"), _hash(F.col("words"), i).alias("hash"), F.slice("words", i + 1, F.lit(2 * longest)).alias("near"))
    hits = texts.select("row", "id", n.cast("long").alias("n_words"), F.explode_outer(F.transform(hits, near)).alias("hit"))
    votes = hits.select("row", "id", "n_words", "hit.*").join(F.broadcast(grams), "hash", "left").withColumn("diagonal", F.col("place") - F.col("at"))

    keys = ["row", "id", "n_words", "template"]
    diagonals = votes.groupBy(*keys, "diagonal").agg(F.count("at").alias("votes"), F.min_by("near", "at").alias("near"), F.min("at").alias("first"))
    diagonals = diagonals.join(F.broadcast(facts.select("template", "phrase")), "template", "left")
    along = Window.partitionBy(*keys).orderBy("diagonal")
    width, need = F.size("phrase"), F.size("phrase") - K + 1
    whole = (F.col("votes") == need) & (F.slice("near", 1, width) == F.col("phrase"))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True)) | F.coalesce(F.lag("whole").over(along), F.lit(False)) | F.col("whole")
    islands = diagonals.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("island", F.sum(apart.cast("int")).over(along))
    merged = islands.groupBy(*keys, "island").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").cast("long").alias("start"), F.max("whole").alias("whole"), F.min_by("near", F.struct("first", "diagonal")).alias("near"), F.min("first").alias("first")
    ).join(F.broadcast(facts), "template", "left")
    rest = F.array_distinct(F.slice("phrase", F.col("first") + 1, width))
    share = F.size(F.array_intersect(rest, F.slice("near", 1, width + GAP))) / F.size(F.array_distinct("phrase"))
    cover = F.when(F.col("whole"), F.lit(1.0)).otherwise(F.least(F.col("votes") / need, share, F.lit(0.99)))
    passes = F.col("whole") | ((F.col("votes") >= MIN_VOTES * need) & (share >= MIN_WORDS))
    span = F.when(F.coalesce(passes, F.lit(False)), F.struct("label", (F.col("base") & F.col("whole")).alias("base"), "start", width.alias("words"), cover.alias("cover")))
    return merged.withColumn("span", span).groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_list("span")).alias("spans")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_of(scan(table(spark, sf_dir, "documents")))


def query_of(found: DataFrame) -> DataFrame:
    """Counts, places, labels and score from the spans."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    joined = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("spans").alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
