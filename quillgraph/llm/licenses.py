"""License scans by diagonal voting.

Texts are cut into lower-case words, once. All rolling K-word hashes of all texts are joined to those of
the templates and their words compared, so that no collision counts; a match votes for the diagonal (place
in the text minus place in the template). Diagonals at most SHIFT apart are merged, and a merged span counts
as verified if it covers MIN_SHARE of the template's K-grams within a span of at most the template's words
plus SLACK. Beside that stand the base phrases.

All is DataFrame code. Templates are a table (template, text) of the caller's, or those of this module; only the
latter, of a known size, are broadcast by a hint. A name ending in -notice or -text gives the label before that. Templates of
fewer than K words match nothing.

A null text counts as empty, a text of any length is scanned whole. Rows are judged one by one: rows that
are equal in doc_id and text get equal results, several labels of a text are sorted, and of several spans of
a template the best share counts. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

K, SHIFT, MIN_SHARE, SLACK = 3, 2, 0.8, 4
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-text": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
}
#: A-Z alone are lower-cased. lower() differs in two characters only that it turns into ASCII letters.
_ODD = "Kİ"
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def _lowered(text: Column) -> Column:
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(f"[{_ODD}]"), ascii_lower).otherwise(F.lower(text))


def _cut(text: Column) -> Column:
    return F.filter(F.split(_lowered(text), _SPLIT), lambda w: w != "")


def templates(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """Rows (template, tpos, gram, n_grams, words) of the given texts (template, text), hashed as documents are."""
    texts = texts if texts is not None else spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")
    cut = texts.select("template", _cut(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= K)
    n_grams = (F.size("w") - (K - 1)).alias("n_grams")
    rows = cut.select("template", "w", n_grams, F.explode(F.sequence(F.lit(0), F.size("w") - K)).alias("tpos"))
    own = rows.select("template", "tpos", "n_grams", F.array_join(F.slice("w", F.col("tpos") + 1, K), " ").alias("words"))
    return own.select("template", "tpos", F.xxhash64("words").alias("gram"), "n_grams", "words")


def _base(w: Column) -> Column:
    """n_words and the places of the base phrases, of an array of words."""
    j = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    spaces = lambda s: (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")

    def places(j: Column) -> Column:
        n, first, last, labels, any_of = F.lit(0).cast("long"), [], [], [], F.lit(False)
        for phrase, label in PHRASES.items():
            padded, turned = f" {phrase} ", f" {phrase} "[::-1]
            has = F.contains(j, F.lit(padded))
            any_of = any_of | has
            n = n + F.when(has, F.regexp_count(j, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long")
            first.append(F.when(has, spaces(F.substring(j, F.lit(1), F.instr(j, padded) - 1))))
            after = F.instr(F.reverse(j), turned) + len(padded) - 1  # from the end, up to the space before the phrase
            last.append(F.when(has, spaces(F.substring(j, F.lit(1), F.length(j) - after))))
            labels.append(F.when(has, F.lit(label)))
        return F.struct(
            F.when(any_of, n).otherwise(0).cast("long").alias("n_base"), F.when(any_of, F.least(*first)).alias("first_word"),
            F.when(any_of, F.greatest(*last)).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
        )

    return F.transform(F.array(j), places)[0]


def scanned(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Of each text a row with the measures of the base phrases, and a row for each hit in a template with its place.

    Each text is cut into words once: its measures go along with its K-grams, of which only hits stay, and with one
    more row before them (no template).
    """
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Only a K-gram's own words go along with it: rows made of one text must not each hold the whole of it.
    grams = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (K - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, K)]))
    made = F.transform(F.array(_cut(whole)), lambda w: F.struct(F.concat(F.array(F.lit("")), grams(w)).alias("grams"), _base(w).alias("b"), F.size(w).cast("long").alias("n")))[0]
    keyed = docs.select("doc_id", F.xxhash64("doc_id", whole).alias("k1"), F.hash("doc_id", whole).alias("k2"), made.alias("m"))
    rolled = keyed.select("doc_id", "k1", "k2", F.col("m.n").alias("n_words"), F.col("m.b").alias("b"), F.posexplode("m.grams").alias("at", "words"))
    rolled = rolled.withColumn("gram", F.xxhash64("words"))
    same = (F.col("r.gram") == F.col("t.gram")) & (F.col("r.words") == F.col("t.words"))
    hits = rolled.alias("r").join(known.alias("t"), same, "left").where("template IS NOT NULL OR at = 0")
    return hits.select("doc_id", "k1", "k2", "n_words", "b.*", (F.col("at") - 1).alias("pos"), "template", "tpos", "n_grams")


def votes(hits: DataFrame) -> DataFrame:
    """Verified spans: k1, k2 (keys of the row), template, first_word, share of the template's K-grams."""
    hits = hits.where("template IS NOT NULL").select("k1", "k2", "template", "tpos", "n_grams", "pos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    by_diagonal = hits.groupBy("k1", "k2", "template", "diagonal").agg(F.collect_set("tpos").alias("tposs"), F.max("n_grams").alias("n_grams"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # Neighbouring diagonals whose spans are near each other merge: a word more or less shifts a diagonal by one.
    order = W.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SHIFT) | F.lag("diagonal").over(order).isNull()
    runs = by_diagonal.withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    merged = runs.groupBy("k1", "k2", "template", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tposs")))).alias("votes"), F.max("n_grams").alias("n_grams"), F.min("lo").alias("first_word"), F.max("hi").alias("hi"))
    share = F.col("votes") / F.col("n_grams")
    fits = F.col("hi") - F.col("first_word") + 1 <= F.col("n_grams") + SLACK
    return merged.where((share >= MIN_SHARE) & fits).select("k1", "k2", "template", "first_word", share.alias("share"))


def digest(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per document: places of base phrases, labels of both ways, and a score; ``texts`` are templates.

    The score is 1 where a base phrase stands, else the greatest share of a template that a verified span covers, else 0.
    """
    spark = docs.sparkSession
    known = templates(spark, texts)
    hits = Scratch(spark, "licenses").save(scanned(docs.select("doc_id", "text"), F.broadcast(known) if texts is None else known), "hits")
    found = votes(hits).groupBy("k1", "k2").agg(F.collect_set(F.regexp_replace("template", "-(notice|text)$", "")).alias("more"), F.max("share").alias("share"))
    rows = hits.where("pos < 0").join(found, ["k1", "k2"], "left")
    both = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), score.cast("double").alias("score"),
    )
