r"""License scans: phrase places, and an exact set-similarity join of text blocks with notices.

A block is a window of words that ignores line ends, so that a wrapped notice is found: as many words
as the notice has, and a quarter more for what stands between its lines; words scattered over a longer stretch are
no block. Windows are tried inside pieces of twice the longest window, each begun one such length after the
last, so that every window lies in a piece. A block's set is its words. A notice's words are ordered by
their count in the whole corpus, rarest first. A block that contains CONTAINMENT of a notice's words must hold
one of its first n - needed + 1 (prefix filter); it must have enough words (length filter); and the first
shared word alone speaks for a pair, with enough known words from it on (positional filter). A piece must pass
what its windows must. What is left is counted exactly, window by window.
DataFrame operations only.

Nulls: a null text is empty; rows with a null id get no labels of the join. Repeated ids share the join's labels.
Of equally good windows any one counts: only label and containment come out. Very long texts are read whole. Empty
tables give empty results; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words once A-Z counts as letters too, and what stands between words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9

# Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Notices of public licenses and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(c: Column) -> Column:
    return F.filter(F.split(lower_ascii(c), GAP), lambda w: w != "")


def needed(n: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(n * containment - 1e-9)


def window_size(notice: str) -> int:
    n = len(notice.split())
    return n + math.ceil(n / 4)


def base_scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases=PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, and the places (label, start) of the phrases."""
    t = F.coalesce(F.col(text), F.lit(""))
    any_phrase = "(?i)" + "|".join(GAP.join(p.split()) for p, _ in phrases)
    hit = t.rlike(any_phrase)
    rows = docs.select(F.col(key).alias("doc_id"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"), F.when(hit, words_of(t)).otherwise(F.array().cast("array<string>")).alias("_words"))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        at = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(F.array().cast("array<int>"))

        def here(i: Column) -> Column:
            ok = F.get("_words", i) == parts[0]
            for d, w in enumerate(parts[1:], 1):
                ok = ok & F.coalesce(F.get("_words", i + d) == w, F.lit(False))
            return ok

        return F.transform(F.filter(at, here), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))

    return rows.select("doc_id", "n_words", F.concat(*[places(p, x) for p, x in phrases]).alias("places"))


def notice_join(docs: DataFrame, text: str = "text", key: str = "doc_id", notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, label, containment of every (block, notice) pair at or above the threshold; several rows per document may come."""
    spark = docs.sparkSession
    sets = [(sorted(set(p.split())), label, window_size(p)) for p, label in notices]
    vocabulary = sorted({w for s, _, _ in sets for w in s})
    longest = max(size for _, _, size in sets)
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    known = spark.sql("SELECT explode(split('" + " ".join(vocabulary) + "', ' ')) AS word")
    counted = texts.select(F.explode(words_of(F.col("_text"))).alias("word")).join(F.broadcast(known), "word").groupBy("word").count()
    count = {r.word: r["count"] for r in counted.collect()}  # at most the notices' own words
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    rare: dict[str, list[tuple[int, str]]] = {}
    for n, (s, _, _) in enumerate(sets):
        first = sorted(s, key=order.get)[: len(s) - needed(len(s), containment) + 1]
        for i, w in enumerate(first):
            rare.setdefault(w, []).append((n, " ".join(first[:i])))
    text_list = lambda ws: F.split(F.lit(" ".join(ws)), " ")
    prefix = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', '{before}', {needed(len(sets[n][0]), containment)}, {len(sets[n][0])}, {sets[n][2]}, '{' '.join(sets[n][0])}', '{sets[n][1]}')" for w, at in sorted(rare.items()) for n, before in at) + " AS t(_word, _before, _needed, _size, _window, _set, label)")
    some = texts.withColumn("_all", words_of(F.col("_text"))).where(F.arrays_overlap("_all", text_list(sorted(rare)))).drop("_text")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_all") - 1, F.lit(0)) / longest).cast("int"))
    pieces = F.transform(starts, lambda k: F.slice("_all", k * longest + 1, 2 * longest))
    blocks = some.select("doc_id", F.explode(pieces).alias("block"))
    some = blocks.withColumn("words", F.array_distinct("block")).where(F.arrays_overlap("words", text_list(sorted(rare))))
    ranks = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)])
    some = some.select("doc_id", "block", "words", F.array_sort(F.transform(F.array_intersect("words", text_list(vocabulary)), lambda w: F.element_at(ranks, w))).alias("_ranks"))
    pairs = some.select("*", F.explode(F.array_intersect("words", text_list(sorted(rare)))).alias("_word")).join(F.broadcast(prefix), "_word")
    at = F.array_position("_ranks", F.element_at(ranks, F.col("_word")))
    pairs = pairs.where((F.size("words") >= F.col("_needed")) & (F.size("_ranks") - at + 1 >= F.col("_needed")) & ~F.arrays_overlap("words", F.split("_before", " ")))
    shared = lambda ws: F.size(F.array_intersect(F.split("_set", " "), ws))
    windows = F.transform(F.sequence(F.lit(1), F.size("block")), lambda i: shared(F.slice("block", i, F.col("_window"))))
    pairs = pairs.where(shared(F.col("words")) >= F.col("_needed")).withColumn("_shared", F.array_max(windows))
    return pairs.where(F.col("_shared") >= F.col("_needed")).select("doc_id", "label", (F.col("_shared") / F.col("_size")).alias("containment"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = base_scan(docs, text, key)
    more = notice_join(docs, text, key).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
    starts = F.transform("places", lambda p: p["start"])
    own = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    both = F.array_sort(F.array_union(own, F.coalesce("_more", F.array().cast("array<string>"))))
    return base.join(more, base.doc_id == more._id, "left").select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    def place(p: str, label: str) -> str:
        ws = p.split()
        test = " AND ".join(f"w[i + {d}] = '{x}'" for d, x in enumerate(ws))
        return f"SELECT r, '{label}' AS label, i - 1 AS start FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs WHERE list_contains(w, '{ws[0]}')) WHERE {test}"

    places = " UNION ALL ".join(place(p, x) for p, x in PHRASES)
    notices = ", ".join(f"({sorted(set(p.split()))}, '{x}', {needed(len(set(p.split())))}, {window_size(p)})" for p, x in NOTICES)
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS ({places}),
base AS (SELECT r, count(*) AS n, min(start) AS a, max(start) AS b, list_sort(list(DISTINCT label)) AS own FROM places GROUP BY r),
notices(s, label, needed, size) AS (VALUES {notices}),
likely AS (SELECT doc_id, w, s, label, needed, size FROM docs, notices WHERE doc_id IS NOT NULL AND len(list_intersect(s, list_distinct(w))) >= needed),
tried AS (SELECT doc_id, label, s, needed, list_distinct(w[i:i + size - 1]) AS ws FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely)),
found AS (SELECT doc_id, label, len(list_intersect(s, ws)) AS k, len(s) AS m FROM tried WHERE len(ws) >= needed AND len(list_intersect(s, ws)) >= needed),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(k::DOUBLE / m) AS best FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  coalesce(array_to_string(own, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs d LEFT JOIN base USING (r) LEFT JOIN more m ON d.doc_id = m.doc_id
"""


OP2_SQL = _oracle()
