"""License scans as an exact set-similarity join of text blocks with notice templates, DataFrame functions only.

A text's words are cut into blocks of ``BLOCK`` words that overlap by half, so
every stretch of ``BLOCK // 2`` words lies whole in one.  A block matches a
template if it holds at least ``THRESHOLD`` of the template's distinct words.

The join: all template words are counted over the whole corpus and put in one
order, rarest first.  A template's prefix is as many of its first words as a
match can't miss all of; blocks and templates meet on a shared prefix word at
their first common word, whose places in both (position) and the number of
words left behind them (length) must leave room for the overlap needed.  Every
pair that meets is then verified, so exactly the matching blocks come out.

Only template words matter to an overlap, so a block is stood for by those.
The templates, a fixed list of a few hundred words, are broadcast and their
word order goes through the driver; nothing that grows with the corpus does.

Cases: a null or empty text has no words, no label and score 0; rows with
equal or null doc_id each give their own row; repeated rows repeat; an empty
table gives an empty result; long texts are scanned whole; other columns are
left aside, whatever their names.  Ties: templates of one label count once, and
the score is the largest share, which ties can't change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK = 64
THRESHOLD = 0.9

# The phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Sentences of public licenses, by label, in words of a-z, 0-9 and at most BLOCK // 2 of them.
TEMPLATES = [
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means"),
]


def words_of(text: Column) -> Column:
    """Words of a text, lowered; a null text has none.

    Of the letters beyond A-Z that lowering turns, only the Kelvin sign becomes
    a-z alone; it is taken out of the way, so template words meet what lowering
    A-Z alone gives.
    """
    return F.filter(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00df"))), BETWEEN), lambda w: w != "")


def templates(spark: SparkSession, listed=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """template (number), label, n, need and the distinct words of each."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.array_distinct(F.split(F.lit(text), " ")).alias("of")) for i, (label, text) in enumerate(listed)])
    t = spark.range(1).select(F.inline(rows)).withColumn("n", F.size("of"))
    return t.withColumn("need", F.ceil(F.col("n") * F.lit(threshold).cast("decimal(9,6)")).cast("int"))


def word_order(words: DataFrame, known: list[str]) -> list[str]:
    """The template words, rarest in the column ``words`` first; ties by code point."""
    found = words.select(F.explode(F.filter("words", lambda w: w.isin(known))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}  # at most as many as the templates have words
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _places_of(phrase: list[str], label: str) -> Column:
    """Starts of a phrase among the candidate ``places`` of ``words``."""
    here = lambda i: F.forall(F.array(*[F.coalesce(F.get(F.col("words"), i + k) == p, F.lit(False)) for k, p in enumerate(phrase)]), lambda x: x)
    return F.transform(F.filter("places", lambda i: here(i)), lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame, listed=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document row: doc_id, n_words, base (array of start, label) and matches (array of block, label, template, share)."""
    spark, half = docs.sparkSession, block // 2
    if any(len(text.split()) > half for _, text in listed):
        raise ValueError(f"a template has more than {half} words")
    t = templates(spark, listed, threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", F.md5(text).alias("digest"), words_of(text).alias("words"))
    order = word_order(words, sorted({w for _, x in listed for w in x.split()}))
    ranks = F.array(*[F.lit(w) for w in order])
    # a template's words in the common order; its prefix is what n - need misses can't skip
    t = t.withColumn("of", F.array_intersect(ranks, F.col("of"))).withColumn("prefix", F.slice("of", 1, F.col("n") - F.col("need") + 1))
    first = [r["w"] for r in t.select(F.explode("prefix").alias("w")).distinct().collect()]  # template words again
    least = t.agg(F.min("need")).first()[0]
    heads = sorted({p.split()[0] for p in PHRASES})

    d = words.withColumn("n_words", F.size("words").cast("long"))
    d = d.withColumn("places", F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(sorted({*first, *heads})), i))))
    base = [_places_of(phrase.split(), label) for phrase, label in PHRASES.items()]
    rare = F.filter("places", lambda i: F.get(F.col("words"), i).isin(first))
    blocks = F.array_distinct(F.flatten(F.transform(rare, lambda i: F.array(F.floor(i / half).cast("int"), F.greatest(F.floor(i / half) - 1, F.lit(0)).cast("int")))))
    d = d.withColumns({"base": F.concat(*base), "blocks": F.transform(blocks, lambda b: F.struct(b.alias("block"), F.array_intersect(ranks, F.slice("words", b * half + 1, block)).alias("has")))})
    d = d.select("doc_id", "digest", "n_words", "base", F.filter("blocks", lambda b: F.size(b["has"]) >= least).alias("blocks"))

    key = ["doc_id", "digest", "n_words", "base"]
    # each document row also sends a row without a block, which counts the copies when rows meet again by id and digest of the text
    probe = d.select(*key, F.explode(F.concat(F.array(F.lit(None).cast("struct<block:int,has:array<string>>")), F.col("blocks"))).alias("b")).select(*key, "b.block", "b.has")
    probe = probe.select("*", F.posexplode_outer(F.slice("has", F.lit(1), F.size("has") - least + 1)).alias("i", "w"))
    build = t.select("template", "label", "of", "n", "need", F.posexplode("prefix").alias("j", "w"))
    pairs = probe.join(F.broadcast(build), "w", "left").where(F.col("block").isNull() | F.col("template").isNotNull())  # the fixed template list
    room = (F.size("has") - F.col("i") >= F.col("need")) & (F.col("n") - F.col("j") >= F.col("need"))
    first_common = (F.col("i") == 0) | ~F.arrays_overlap(F.slice("has", F.lit(1), F.greatest(F.col("i"), F.lit(1))), F.col("of"))
    shared = F.when(room & first_common, F.size(F.array_intersect("has", "of")))
    found = pairs.withColumn("shared", shared).where("block IS NULL OR shared >= need")
    rows = found.select(*key, F.when(F.col("block").isNotNull(), F.struct("block", "label", "template", (F.col("shared") / F.col("n")).alias("share"))).alias("m"))
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_set("m")).alias("matches"), F.count_if(F.col("m").isNull()).alias("copies"))
    return out.select("doc_id", "n_words", "base", "matches", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def license_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    score: 1 where a base phrase stands, else the largest share of a template
    that one block holds, 0 without a match.
    """
    d = scan(docs, **how)
    starts, named = F.transform("base", lambda x: x["start"]), lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(named("base")).alias("base_labels"), joined(F.concat(named("base"), named("matches"))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        F.size(F.array_distinct(F.transform("matches", lambda x: x["block"]))).cast("long").alias("n_blocks"),
    )


ORACLE = r"""
WITH t AS (SELECT label, list_distinct(string_split(phrase, ' ')) AS words, len(list_distinct(string_split(phrase, ' '))) AS n FROM (VALUES %s) v(label, phrase)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '%s', '%s'), '%s'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT r, b, list_distinct(w[b * 32 + 1 : b * 32 + 64]) AS has FROM (SELECT r, w, unnest(range(0, (len(w) + 31) // 32)) AS b FROM d)),
m AS (SELECT r, b, label, len(list_intersect(has, words)) / n AS share FROM b JOIN t ON list_has_any(has, words) WHERE len(list_intersect(has, words)) >= 0.9 * n),
a AS (SELECT r, list(label) AS labels, max(share) AS share, count(DISTINCT b) AS n_blocks FROM m GROUP BY r),
p AS (SELECT phrase, label, string_split(phrase, ' ') AS q FROM (VALUES %s) v(phrase, label)),
x AS (SELECT r, label, start FROM (SELECT r, w, label, q, unnest(range(0, len(w) - len(q) + 1)) AS start FROM d JOIN p ON list_has_all(w, q)) WHERE w[start + 1 : start + len(q)] = q),
y AS (SELECT r, count(*) AS n, min(start) AS f, max(start) AS l, list(label) AS labels FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(coalesce(y.labels, []))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(y.labels, []), coalesce(a.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN a USING (r) LEFT JOIN y USING (r)
""" % (", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES), UPPER, LOWER, BETWEEN, ", ".join(f"('{a}', '{b}')" for a, b in PHRASES.items()))
