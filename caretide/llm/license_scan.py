"""License statements by diagonal voting.

Every rolling three-word hash of a text is joined to the places of the same three words in a set of templates. A hit
at word ``pos`` of the text and ``tpos`` of the template votes for the diagonal ``pos - tpos``. Votes are counted per
document, template and diagonal; neighbouring diagonals (words inserted or left out) are merged; a span counts if
enough of the template is on it. Hash hits are confirmed word by word before they vote, so a phrase whose votes are
complete on one diagonal stands there word for word.

The templates are a fixed table of a few hundred rows and are broadcast; only hits and one row per document leave a
map task.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from caretide.llm.common import ALNUM_WORD, alnum_words, at

#: Words in a rolling hash.
K = 3
#: Diagonals closer than this belong to one span.
MERGE = 4
#: A template is named if this share of its hashes is on one span, which may be this many times as long; a short one
#: (fewer hashes than SHORT) must be complete, as one word may be all that tells two versions apart.
COVERAGE, STRETCH, SHORT = 0.8, 1.5, 20

# Phrases and labels of the result contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Openings of well-known public licenses.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation",
    ),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]


def _words(text: str) -> list[str]:
    return re.findall(ALNUM_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def template_places(spark: SparkSession) -> DataFrame:
    """One row per template and place: t, label, base, size (number of hashes), tpos, gram (its words) and hash."""
    rows = []
    for t, (label, text, base) in enumerate([(v, k, True) for k, v in PHRASES.items()] + [(a, b, False) for a, b in TEMPLATES]):
        w = _words(text)
        rows += [(t, label, base, len(w) - K + 1, i, w[i : i + K]) for i in range(len(w) - K + 1)]
    places = spark.createDataFrame(rows, "t int, label string, base boolean, size int, tpos int, gram array<string>")
    return places.withColumn("hash", F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(K))))


def votes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Confirmed hits (t not null) and, whatever it hits, the first word of every document."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), alnum_words(F.col(text)).alias("words"))
    each = words.select("doc_id", "text_hash", F.size("words").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "word"))
    rolling = each.withColumn(
        "hash", F.when(F.col("pos") + K <= F.col("n_words"), F.xxhash64("word", *(at("words", i) for i in range(1, K))))
    )
    places = F.broadcast(template_places(docs.sparkSession))
    same_words = F.col("word") == F.get("gram", F.lit(0))
    for i in range(1, K):
        same_words &= at("words", i) == F.get("gram", F.lit(i))
    hits = rolling.join(places, (rolling["hash"] == places["hash"]) & same_words, "left")
    # n_words of an empty text has neither a place nor a hit
    return hits.filter(F.col("t").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)).select(
        "doc_id", "text_hash", "n_words", "pos", "t", "label", "base", "size", "tpos"
    )


def license_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans per document: doc_id, text_hash, n_words, label, base, size, start and end word, coverage (0 to 1).

    A document without spans has one row with null label. Complete phrases and templates are one span a place;
    partial ones are merged over neighbouring diagonals and reported whatever their coverage.
    """
    key = ["doc_id", "text_hash", "n_words"]
    diagonals = (
        votes(docs, doc_id, text)
        .groupBy(*key, "t", "label", "base", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        # places of the template that were hit, once each however often the row is repeated; no template has 64 of them
        .agg(F.coalesce(F.bit_count(F.bit_or(F.expr("shiftleft(1L, tpos)"))), F.lit(0)).alias("n"), F.min("pos").alias("start"), (F.max("pos") + K).alias("end"))
    )
    # a row made for its first word alone votes for nothing
    by_place = Window.partitionBy(*key, "t").orderBy("diagonal")
    # what is complete by itself is a span of its own
    complete = F.col("n") >= F.col("size")
    alone = complete | F.coalesce(F.lag(complete).over(by_place), F.lit(False))
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_place) > MERGE, F.lit(True)) | F.col("base") | F.coalesce(alone, F.lit(False))
    spans = (
        diagonals.withColumn("new", new.cast("int"))
        .withColumn("span", F.sum("new").over(by_place))
        .groupBy(*key, "t", "label", "base", "size", "span")
        .agg(F.sum("n").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    )
    tight = F.col("end") - F.col("start") <= F.greatest((F.col("size") + K - 1) * STRETCH, F.lit(0))
    coverage = F.when(tight, F.least(F.col("n") / F.col("size"), F.lit(1.0))).otherwise(F.lit(0.0))
    return spans.select(*key, "label", "base", "size", "start", "end", F.when(F.col("t").isNotNull(), coverage).alias("coverage"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(labels), ",")


def license_labels(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base (places of complete phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (sorted, comma-joined, empty if none) and score (the best coverage).

    Null or empty text: no words, no labels, score 0. Rows repeated with id and text count as one document; rows that
    share an id but not the text stay apart. Empty table: no rows. Other columns of ``docs`` are not read.
    """
    spans = license_spans(docs, doc_id, text)
    full = F.col("base") & (F.col("coverage") >= 1.0)
    named = full | (~F.col("base") & (F.col("coverage") >= F.when(F.col("size") < SHORT, 1.0).otherwise(COVERAGE)))
    out = spans.groupBy("doc_id", "text_hash", "n_words").agg(
        F.count(F.when(full, 1)).alias("n_base"),
        F.min(F.when(full, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(full, F.col("start"))).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(full, F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(named, F.col("label")))).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("n_words", F.col("n_words").cast("long")).drop("text_hash")
