"""License scans by diagonal voting, with DataFrame functions only.

Every run of k words of every text is hashed and joined to the places that the run has in the license
templates, and its words are compared. A hit votes for the offset (diagonal) of the text's words against
the template's. A phrase stands where its diagonal has all votes. A notice may have been changed: votes
of neighbouring diagonals, which a few added or missing words shift, are put together, and the span
they make counts if it holds enough of the template's words and not many others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm.common import column
from clauseloom.session import cut_lineage

#: Words of a run, for phrases and for notices: phrases are short, and two words of a notice occur anywhere.
PHRASE_RUN, NOTICE_RUN = 2, 4
#: Words by which neighbouring diagonals may differ.
GAP = 4
#: Share of a notice's words that a span must hold, and the span's words at most, in notices.
SHARE, STRETCH = 0.8, 1.5
#: Templates are broadcast, so their words are bounded.
TEMPLATE_WORDS = 50_000

#: The base phrases (phrase, label).
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Usual notices and statements of licenses (text, label).
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lgpl"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "mpl"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib"),
    ("Licensed under CC BY 4.0", "cc-by"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("distributed under the terms of the Boost Software License, Version 1.0", "bsl"),
    ("Distributed under the Boost Software License, Version 1.0", "bsl"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before and after A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: letters A-Z in lower case, digits and all that isn't ASCII."""
    return F.translate(_cut(text), UPPER, LOWER)


def _cut(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_array(text: Column, lowered: bool = True) -> Column:
    source = words(text) if lowered else _cut(text)
    return F.array_remove(F.split(source, BETWEEN), "")


def _pairs(runs: Column, apart: int) -> Column:
    """Runs of words, from those that they begin and, ``apart`` words later, end with."""
    n = F.greatest(F.size(runs) - apart, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(1 + apart), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _grams(df: DataFrame, of: str) -> DataFrame:
    """(all columns but ``of``, k, at, run, h): every run of PHRASE_RUN and of NOTICE_RUN words of the
    array column ``of``, where it begins, and its hash. What is unfolded is as long as the text, so no
    row may hold the array."""
    keep = [c for c in df.columns if c != of]
    two = df.select(*keep, _pairs(F.col(of), PHRASE_RUN // 2).alias("_two"))
    both = two.select(*keep, F.size("_two").alias("_n"), F.concat("_two", _pairs(F.col("_two"), NOTICE_RUN // 2)).alias("_all"))
    # The outer form keeps the planner from adding a test for empty arrays, for which it would make
    # them once more; empty ones give a null run, which equals none.
    rows = both.select(*keep, "_n", F.posexplode_outer("_all").alias("_at", "run"))
    short = F.col("_at") < F.col("_n")
    return rows.select(*keep, F.when(short, PHRASE_RUN).otherwise(NOTICE_RUN).alias("k"), F.when(short, F.col("_at")).otherwise(F.col("_at") - F.col("_n")).alias("at"), "run", F.xxhash64("run").alias("h"))


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """(t, label, base, length, p, known, th): a row for each run of each template, of PHRASE_RUN
    words in a phrase and of NOTICE_RUN words in a notice."""
    rows = [(t, label, t < len(phrases), text) for t, (text, label) in enumerate([*phrases, *notices])]
    size = sum(len(r[3]) for r in rows) // 2 + len(rows)  # words at most
    if size > TEMPLATE_WORDS:
        raise ValueError(f"templates may have {TEMPLATE_WORDS} words, as they are broadcast")
    made = spark.createDataFrame(rows, "t int, label string, base boolean, text string")
    made = made.select("t", "label", "base", word_array(F.col("text")).alias("w")).withColumn("length", F.size("w"))
    grams = _grams(made, "w").filter(F.col("k") == F.when(F.col("base"), PHRASE_RUN).otherwise(NOTICE_RUN))
    return grams.select("t", "label", "base", "length", F.col("at").alias("p"), F.col("run").alias("known"), F.col("h").alias("th"))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(k1, k2, t, label, base, length, diagonal, p): where a run of words of a text is one of a
    template, each place once for all equal texts."""
    grams = _grams(docs.select("k1", "k2", word_array(F.col("text")).alias("w")), "w")
    met = grams.join(F.broadcast(known), F.col("h") == F.col("th")).filter(F.col("run") == F.col("known"))
    return met.select("k1", "k2", "t", "label", "base", "length", (F.col("at") - F.col("p")).alias("diagonal"), "p").distinct()


def spans(found: DataFrame) -> DataFrame:
    """(k1, k2, label, base, start, share): the phrases, and the verified spans of notices."""
    key = ["k1", "k2", "t", "label", "base", "length"]
    votes = found.groupBy(*key, "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.when(~F.col("base"), F.col("p"))).alias("ps"))
    votes = cut_lineage(votes)
    phrases = votes.filter(F.col("base") & (F.col("votes") == F.col("length") - (PHRASE_RUN - 1)))
    phrases = phrases.select("k1", "k2", "label", "base", F.col("diagonal").alias("start"), F.lit(1.0).alias("share"))
    # A window holds the diagonals of one text against one notice; a new span begins where two are far apart.
    apart = F.expr(f"if(diagonal - lag(diagonal) over (partition by k1, k2, t order by diagonal) <= {GAP}, 0, 1)")
    merged = votes.filter(~F.col("base")).withColumn("opens", apart).withColumn("span", F.expr("sum(opens) over (partition by k1, k2, t order by diagonal)"))
    # Words of the template and of the text that the span's runs cover.
    runs = merged.groupBy(*key, "span").agg(F.collect_list(F.struct("diagonal", "ps")).alias("ds"))
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform("ds", lambda d: F.flatten(F.transform(d["ps"], lambda p: F.sequence(at(d, p), at(d, p) + NOTICE_RUN - 1)))))))
    runs = runs.withColumns({"own": covered(lambda d, p: p), "theirs": covered(lambda d, p: d["diagonal"] + p), "start": F.array_min(F.transform("ds", lambda d: d["diagonal"] + F.array_min(d["ps"]))), "end": F.array_max(F.transform("ds", lambda d: d["diagonal"] + F.array_max(d["ps"]))) + NOTICE_RUN})
    share = F.least("own", "theirs") / F.col("length")
    notices = runs.filter((share >= SHARE) & (F.col("end") - F.col("start") <= STRETCH * F.col("length")))
    return phrases.union(notices.select("k1", "k2", "label", "base", "start", share.alias("share")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score), one
    row per row. Places count words from 0; n_base counts all places of ``phrases``, ``labels`` has the
    notices' too. score is the largest share of a template's words in a span, 1 for a phrase, 0 without.

    A null text is empty; texts without words have no labels. Rows that repeat give repeated rows, null
    ids stay null, no rows give none; other columns play no part. Texts are told apart by 128 bits of
    hash, and equal ones are scanned as one.
    """
    full = F.coalesce(column(docs, text), F.lit(""))
    keys = [F.xxhash64(full).alias("k1"), F.xxhash64(F.lit(1), full).alias("k2")]
    found = spans(hits(docs.select(*keys, full.alias("text")), templates(docs.sparkSession, phrases, notices)))
    base = F.col("base")
    of = found.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    # Written, so that the join can split a text that many rows share.
    of = cut_lineage(of)
    rows = docs.select(column(docs, doc_id).alias("doc_id"), *keys, F.size(word_array(full, lowered=False)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(of, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op13_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = scan(docs)
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def op13_sql() -> str:
    """The same in SQL, by the runs' words instead of their hashes."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    made = ",\n  ".join(f"({t}, {quoted(label)}, {t < len(PHRASES)}, {quoted(text)})" for t, (text, label) in enumerate([*PHRASES, *NOTICES]))
    return rf"""
WITH template(t, label, base, text) AS (VALUES
  {made}
), tw AS (
  SELECT t, label, base, CASE WHEN base THEN {PHRASE_RUN} ELSE {NOTICE_RUN} END AS k, {cut} AS w FROM template
), tg AS (
  SELECT t, label, base, k, len(w) AS length, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tw)
), d AS (SELECT doc_id, {cut} AS w FROM documents),
dg AS (
  SELECT doc_id, k, i - 1 AS place, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (VALUES ({PHRASE_RUN}), ({NOTICE_RUN})) ks(k) WHERE len(w) >= k)
), votes AS (
  SELECT doc_id, t, label, base, length, place - p AS diagonal, count(*) AS votes, list(p) AS ps
  FROM dg JOIN tg USING (k, run) GROUP BY ALL
), opened AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS opens FROM votes WHERE NOT base
), merged AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM opened
), pieces AS (
  SELECT doc_id, t, label, length, span, diagonal, unnest(ps) AS p FROM merged
), covered AS (
  SELECT doc_id, t, label, length, span, count(DISTINCT p + j) AS own, count(DISTINCT diagonal + p + j) AS theirs, min(diagonal + p) AS start, max(diagonal + p) + {NOTICE_RUN} AS stop
  FROM pieces, range({NOTICE_RUN}) r(j) GROUP BY ALL
), found AS (
  SELECT doc_id, label, true AS base, diagonal AS start, 1.0::DOUBLE AS share FROM votes WHERE base AND votes = length - {PHRASE_RUN - 1}
  UNION ALL
  SELECT doc_id, label, false, start, least(own, theirs)::DOUBLE / length FROM covered
  WHERE least(own, theirs)::DOUBLE / length >= {SHARE} AND stop - start <= {STRETCH} * length
), of AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM found GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN of USING (doc_id)
"""
