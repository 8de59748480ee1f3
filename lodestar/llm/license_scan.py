"""License scans by diagonal voting, in DataFrame and SQL functions only.

Every run of K consecutive words of every text is hashed and joined to the positions of the same run in the templates. A
match at word p of a text and word t of a template votes for the diagonal p - t. Votes are gathered by text, template and
diagonal; neighbouring diagonals (an inserted or missing word moves the diagonal by one) are merged; the spans that are left
are verified: a phrase must have every one of its runs on one diagonal, which means that its words stand there one after
the other, and a notice must have at least COVERAGE of its runs, in a span at most STRETCH times its length.

The join compares the words themselves besides their hash, so a vote is never a collision. The templates are the constants
below, and their number bounds the broadcast. Texts are cut into words on the executors and only votes and one row for each
text are shuffled.

Defined results: a null or empty text has no words, no places and score 0; every row of the input gives one row, whatever its
doc_id; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import documents

K = 3
COVERAGE = 0.7
STRETCH = 1.5
NEIGHBOUR = 3

#: The phrases whose every place is reported, with their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
#: Passages of well-known notices, with their labels.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]

NOT_A_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def templates(spark: SparkSession) -> DataFrame:
    """A row for each run of K words of each template."""
    rows = []
    for number, (text, label, phrase) in enumerate([(*x, True) for x in PHRASES] + [(*x, False) for x in NOTICES]):
        words = text.split()
        runs = len(words) - K + 1
        rows += [(number, label, phrase, runs, t, *words[t : t + K]) for t in range(runs)]
    made = spark.createDataFrame(rows, "template int, label string, phrase boolean, runs int, t int, t0 string, t1 string, t2 string")
    return made.withColumn("run", F.xxhash64("t0", "t1", "t2"))


def words(text: Column) -> Column:
    """Lower-cased words. Lower-casing all letters instead of A-Z alone moves no word's bounds; only the Kelvin sign becomes an ASCII letter by it, the k, which no phrase has."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def votes(docs: DataFrame) -> DataFrame:
    """One row for each run of a text that stands in a template, and one for each text's first word or empty text."""
    spark = docs.sparkSession
    w = F.col("words")
    n = F.greatest(F.size(w), F.lit(1))
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    runs = texts.select("rid", "doc_id", F.size(w).cast("long").alias("n_words"), F.posexplode_outer(F.arrays_zip(w.alias("w0"), F.slice(w, F.lit(2), n).alias("w1"), F.slice(w, F.lit(3), n).alias("w2"))).alias("p", "r"))
    runs = runs.select("rid", "doc_id", "n_words", "p", *[F.col(f"r.w{i}").alias(f"w{i}") for i in range(K)]).withColumn("run", F.xxhash64("w0", "w1", "w2"))
    same = [runs["run"] == F.col("h.run"), *[F.col(f"w{i}") == F.col(f"t{i}") for i in range(K)]]
    joined = runs.join(F.broadcast(templates(spark).alias("h")), same, "left")
    return joined.where(F.col("template").isNotNull() | F.col("p").isNull() | (F.col("p") == 0)).select("rid", "doc_id", "n_words", F.col("p").cast("long").alias("p"), "template", "label", "phrase", "runs", "t")


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans by text: rid, doc_id, n_words, then label, phrase, start, stop and coverage, null where a text has none."""
    found = votes(docs).withColumn("d", F.col("p") - F.col("t"))
    # All that follows is by rid: one shuffle
    found = found.repartition("rid")
    by = ["rid", "template", "d"]
    diagonals = found.groupBy(*by).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("runs").alias("runs"),
        F.collect_set("t").alias("ts"), F.min("p").alias("start"), F.max("p").alias("last"),
    )
    order = W.partitionBy("rid", "template").orderBy("d")
    apart = F.when(F.col("phrase") | F.col("template").isNull(), F.lit(1)).otherwise((F.col("d") - F.lag("d").over(order) > NEIGHBOUR).cast("int"))
    merged = diagonals.withColumn("apart", F.coalesce(apart, F.lit(1))).withColumn("island", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    islands = merged.groupBy("rid", "template", "island").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("runs").alias("runs"),
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("hits"), F.min("start").alias("start"), (F.max("last") + K).alias("stop"),
    )
    coverage = F.col("hits") / F.col("runs")
    sound = F.when(F.col("phrase"), F.col("hits") == F.col("runs")).otherwise((coverage >= COVERAGE) & (F.col("stop") - F.col("start") <= STRETCH * (F.col("runs") + K - 1)))
    sound = F.coalesce(sound, F.lit(False))
    return islands.select("rid", "doc_id", "n_words", *[F.when(sound, c).alias(name) for name, c in (("label", F.col("label")), ("phrase", F.col("phrase")), ("start", F.col("start")), ("stop", F.col("stop")), ("coverage", coverage))])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its counts, labels, score and spans (start:stop:label, words from 0, stop exclusive)."""
    base = F.col("phrase")
    listed = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return spans(docs).groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.when(base, F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.round(F.coalesce(F.max("coverage"), F.lit(0.0)), 6).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("start", "stop", "label")))), lambda x: F.concat_ws(":", x.start, x.stop, x.label)), ",").alias("spans"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    rows = ",\n    ".join(f"({i}, '{label}', {phrase}, '{text}')" for i, (text, label, phrase) in enumerate([(*x, "true") for x in PHRASES] + [(*x, "false") for x in NOTICES]))
    return rf"""
WITH tpl(template, label, phrase, txt) AS (VALUES
    {rows}),
tw AS (SELECT template, label, phrase, string_split(txt, ' ') AS ws FROM tpl),
tg AS (SELECT template, label, phrase, len(ws) - 2 AS runs, unnest(range(len(ws) - 2)) AS t, ws FROM tw),
tgram AS (SELECT template, label, phrase, runs, t, ws[t + 1] || ' ' || ws[t + 2] || ' ' || ws[t + 3] AS g FROM tg),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
dg AS (SELECT doc_id, unnest(range(greatest(len(ws) - 2, 0))) AS p, ws FROM dw),
dgram AS (SELECT doc_id, p, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS g FROM dg),
hit AS (SELECT doc_id, template, label, phrase, runs, t, p, p - t AS d FROM dgram JOIN tgram USING (g)),
diag AS (SELECT doc_id, template, label, phrase, runs, d, list(DISTINCT t) AS ts, min(p) AS s, max(p) AS e
         FROM hit GROUP BY ALL),
mark AS (SELECT *, CASE WHEN phrase THEN 1
                        WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= {NEIGHBOUR} THEN 0 ELSE 1 END AS a
         FROM diag),
isl AS (SELECT *, sum(a) OVER (PARTITION BY doc_id, template ORDER BY d) AS island FROM mark),
sp AS (SELECT doc_id, template, label, phrase, runs, island, len(list_distinct(flatten(list(ts)))) AS hits,
              min(s) AS start, max(e) + 3 AS stop
       FROM isl GROUP BY doc_id, template, label, phrase, runs, island),
ok AS (SELECT *, hits / runs AS coverage FROM sp
       WHERE (phrase AND hits = runs)
          OR (NOT phrase AND hits / runs >= {COVERAGE} AND stop - start <= {STRETCH} * (runs + 2))),
agg AS (SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word,
               max(start) FILTER (phrase) AS last_word,
               array_to_string(list_sort(list_distinct(list(label) FILTER (phrase))), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(coverage) AS score
        FROM ok GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(coalesce(score, 0), 6)::DOUBLE AS score
FROM dw LEFT JOIN agg USING (doc_id)
"""


OP10_SQL = _sql()
