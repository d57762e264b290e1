"""License scan by diagonal voting (native).

All rolling word k-gram hashes of every text are joined with the positions of
the same grams in the templates.  A hit at word ``p`` of a text and word ``q`` of
a template votes for the diagonal ``p - q``.  Votes are counted per (text,
template, diagonal); neighbouring diagonals, which differ by a few inserted or
missing words, are merged to one span.  Every gram is verified word for word in
the join condition, so spans rest on words and not on hashes.

Two kinds of templates: *phrases* (two or three words, grams of two words) count
as places only when all their grams stand on one diagonal, which is the exact
phrase; *notices* (longer texts, grams of four words) count by the share of their
grams found in a merged span.

Defined results: null text counts as empty; a text without words has one row
with zero counts and null places; rows that repeat an id stay separate rows.
Extra columns are not read.  The template table is a parameter of bounded size
(``MAX_TEMPLATE_WORDS``) and is broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import whole_text

PHRASE_K, NOTICE_K = 2, 4
MAX_TEMPLATE_WORDS = 100_000

#: Phrases whose places are counted, with their labels.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Opening sentences of well-known notices, with their labels.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the software without restriction"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: Share of a notice's grams from which its label is given.
COVERAGE = 0.6
#: Diagonals this far apart, and at most so many words between their spans, belong together.
SLACK, GAP = 3, 8

#: Characters of a word, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for the end of a text, which each text has once; no gram hash is taken for it.
_END = -1


def text_words(text: str | Column = "text") -> Column:
    """Words of the text with A-Z lower-cased.

    ``lower`` also changes other letters, which no template holds; the Kelvin sign
    alone would become an ASCII letter, so it is replaced by another letter first.
    """
    return F.regexp_extract_all(F.lower(F.replace(whole_text(text), F.lit("K"), F.lit("é"))), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, n: Column, k: int) -> Column:
    return F.when(at + k <= n, F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)]))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """``gram, t_words, t_pos, template, label, k, grams``: every gram of every template."""
    rows = [{"template": i, "label": label, "text": text, "k": k}
            for i, (label, text, k) in enumerate([(*p, PHRASE_K) for p in phrases] + [(*n, NOTICE_K) for n in notices])]
    if sum(len(r["text"].split()) for r in rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are too many to broadcast")
    listed = spark.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps(rows)), "array<struct<template int, label string, text string, k int>>")))
    words = listed.withColumn("words", text_words()).withColumn("n", F.size("words")).filter("n >= k")
    at = F.col("t_pos")
    return (words.withColumn("t_pos", F.explode(F.expr("sequence(0, n - k)")))
            .select(F.when(F.col("k") == PHRASE_K, _gram(F.col("words"), at, F.col("n"), PHRASE_K))
                    .otherwise(_gram(F.col("words"), at, F.col("n"), NOTICE_K)).alias("gram"),
                    F.expr("slice(words, t_pos + 1, k)").alias("t_words"), "t_pos", "template", "label", "k",
                    (F.col("n") - F.col("k") + 1).alias("grams")))


def gram_hits(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified hit of a gram, and one with ``template`` -1 per text.

    ``rid, doc_id, n_words, template, label, k, grams, pos, t_pos``.
    """
    end = table.sparkSession.range(1).select(
        F.lit(_END).cast("long").alias("gram"), F.array().cast("array<string>").alias("t_words"), F.lit(0).alias("t_pos"),
        F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"), F.lit(0).alias("k"), F.lit(0).alias("grams"))
    rows = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                        text_words(text_col).alias("words"))
            .withColumn("n_words", F.size("words"))
            .withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n_words")))))
    n, at, words = F.col("n_words"), F.col("pos"), F.col("words")
    grams = F.when(at == n, F.array(F.lit(_END).cast("long"), F.lit(None).cast("long"))).otherwise(
        F.array(_gram(words, at, n, PHRASE_K), _gram(words, at, n, NOTICE_K)))
    rows = rows.withColumn("gram", F.explode(grams)).filter(F.col("gram").isNotNull())
    return (rows.join(F.broadcast(table.unionByName(end)).withColumnRenamed("gram", "t_gram"),
                      F.expr("gram = t_gram AND slice(words, pos + 1, k) = t_words"))
            .select("rid", "doc_id", n.cast("long").alias("n_words"), "template", "label", "k", "grams",
                    at.cast("long").alias("pos"), "t_pos"))


def spans(hits: DataFrame) -> DataFrame:
    """Merged spans: ``rid, doc_id, n_words, template, label, k, first, last, votes, coverage``.

    The end marks pass through as spans of template -1.
    """
    diagonals = (hits.groupBy("rid", "doc_id", "n_words", "template", "label", "k", "grams",
                              (F.col("pos") - F.col("t_pos")).alias("diagonal"))
                 .agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"),
                      F.max(F.col("pos") + F.col("k") - 1).alias("last")))
    order = Window.partitionBy("rid", "template").orderBy("first", "diagonal")
    apart = (F.col("k") == PHRASE_K) | F.lag("first").over(order).isNull() \
        | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SLACK) \
        | (F.col("first") > F.lag("last").over(order) + GAP)
    merged = (diagonals.withColumn("opens", apart.cast("int")).withColumn("part", F.sum("opens").over(order))
              .groupBy("rid", "doc_id", "n_words", "template", "label", "k", "grams", "part")
              .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"),
                   F.min("diagonal").alias("diagonal")))
    return merged.withColumn("coverage", F.when(F.col("grams") > 0, F.least(F.lit(1.0), F.col("votes") / F.col("grams"))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES,
                 coverage: float = COVERAGE) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are
    their smallest and largest start.  ``labels`` adds the notices with at least
    ``coverage`` of their grams in one span; ``score`` is the largest coverage of
    any template.
    """
    table = templates(docs.sparkSession, phrases, notices)
    found = spans(gram_hits(docs, table, id_col, text_col).repartition("rid"))
    place = (F.col("k") == PHRASE_K) & (F.col("votes") == F.col("grams"))
    notice = (F.col("k") == NOTICE_K) & (F.col("coverage") >= coverage)
    listed = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return (found.groupBy("rid", "doc_id", "n_words")
            .agg(F.count(F.when(place, 1)).alias("n_base"),
                 F.min(F.when(place, F.col("diagonal"))).alias("first_word"),
                 F.max(F.when(place, F.col("diagonal"))).alias("last_word"),
                 listed(place).alias("base_labels"), listed(place | notice).alias("labels"),
                 F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"))
            .drop("rid"))


def license_sql(phrases=PHRASES, notices=NOTICES, coverage: float = COVERAGE) -> str:
    """The same in ANSI SQL, over a view ``documents``: grams as joined words, votes, merged diagonals."""
    import re

    rows = []
    for i, (label, text, k) in enumerate([(*p, PHRASE_K) for p in phrases] + [(*n, NOTICE_K) for n in notices]):
        words = re.findall(WORD, text.lower())
        rows += [f"({i}, '{label}', {k}, {len(words) - k + 1}, {j}, '{' '.join(words[j:j + k])}')" for j in range(len(words) - k + 1)]
    label_list = "coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER ({}), '')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), 'é')), '{WORD}') AS words FROM documents),
tpl(template, label, k, grams, t_pos, gram) AS (VALUES {', '.join(rows)}),
u AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS pos FROM t),
l AS (SELECT rid, pos, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM u
      WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, {PHRASE_K} AS k, w || ' ' || w2 AS gram FROM l WHERE w2 IS NOT NULL UNION ALL
      SELECT rid, pos, {NOTICE_K}, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM l WHERE w4 IS NOT NULL),
d AS (SELECT rid, template, label, g.k AS k, grams, pos - t_pos AS diagonal, count(*) AS votes, min(pos) AS first, max(pos) + g.k - 1 AS last
      FROM g JOIN tpl ON g.gram = tpl.gram AND g.k = tpl.k GROUP BY rid, template, label, g.k, grams, pos - t_pos),
o AS (SELECT *, CASE WHEN k = {PHRASE_K} OR lag(first) OVER o IS NULL OR abs(diagonal - lag(diagonal) OVER o) > {SLACK}
                       OR first > lag(last) OVER o + {GAP} THEN 1 ELSE 0 END AS opens
      FROM d WINDOW o AS (PARTITION BY rid, template ORDER BY first, diagonal)),
p AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY first, diagonal) AS part FROM o),
s AS (SELECT rid, template, label, k, grams, part, sum(votes) AS votes, min(diagonal) AS diagonal,
             least(1.0, sum(votes)::DOUBLE / grams) AS coverage
      FROM p GROUP BY rid, template, label, k, grams, part),
f AS (SELECT rid, count(*) FILTER (k = {PHRASE_K} AND votes = grams) AS n_base,
             min(diagonal) FILTER (k = {PHRASE_K} AND votes = grams) AS first_word,
             max(diagonal) FILTER (k = {PHRASE_K} AND votes = grams) AS last_word,
             {label_list.format(f"k = {PHRASE_K} AND votes = grams")} AS base_labels,
             {label_list.format(f"(k = {PHRASE_K} AND votes = grams) OR (k = {NOTICE_K} AND coverage >= {coverage})")} AS labels,
             max(coverage) AS score FROM s GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM t LEFT JOIN f ON t.rid = f.rid"""
