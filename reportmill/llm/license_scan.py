"""License scan by diagonal voting.

Every rolling k-gram of words of every text is hashed and joined to the k-grams of the templates. A match of the gram at
word p of a text with the gram at word q of a template votes for the diagonal p - q; votes are added up by text, template
and diagonal. Diagonals of a template within `gap` words of each other are merged (words put in or left out shift the
diagonal), and a merged span counts if it is verified: enough of the template's grams stand in it, compared word by word
and not by hash only, and it isn't much longer than the template.

Base: a phrase stands wherever all its grams vote for one diagonal. The notices add labels of their own.

The templates are a parameter; they are broadcast while they have at most BROADCAST_GRAMS grams and joined by shuffle
beyond that. A template has at most 64 grams, so that its votes fit in the bits of a long; longer texts are given as
several templates.

Null text is empty: no words, no labels, score 0. An empty table gives an empty result. Rows with equal id and text are
scanned as one and given back as often as they came. Only the two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 2
GAP = 3
COVERAGE = 0.85
BROADCAST_GRAMS = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and wording of usual notices (public licence texts).
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", 'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("mit", "Released under the MIT License"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def template_grams(spark: SparkSession, phrases, notices, k: int) -> tuple[DataFrame, int]:
    rows = []
    for t, (label, text, base) in enumerate([*((b, a, True) for a, b in phrases), *((a, b, False) for a, b in notices)]):
        w = template_words(text)
        if not k <= len(w) < 64 + k:
            raise ValueError(f"a template has from {k} to {63 + k} words: {text!r}")
        rows += [(t, label, base, len(w), q, " ".join(w[q : q + k])) for q in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, t_words int, q int, t_gram string").withColumn("t_hash", F.xxhash64("t_gram")), len(rows)


def scan_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, k: int = K, gap: int = GAP, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and `spans` (label:first word:end word of the notices) of every row."""
    grams, n = template_grams(docs.sparkSession, phrases, notices, k)
    grams = F.broadcast(grams) if n <= BROADCAST_GRAMS else grams
    words = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0).alias("words"))
    words = words.withColumn("n_words", F.size("words").cast("long"))
    each = F.transform(F.slice("words", 1, F.greatest(F.col("n_words") - (k - 1), F.lit(0)).cast("int")), lambda w, i: F.struct(i.alias("p"), F.concat_ws(" ", w, *[F.get("words", i + j) for j in range(1, k)]).alias("gram")))
    # A first row without gram stands for the text itself, so that texts without any match stay.
    itself = F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("gram")))
    rolled = words.select("doc_id", "text_hash", "n_words", F.explode(F.concat(itself, each)).alias("g")).select("doc_id", "text_hash", "n_words", F.col("g.p").alias("p"), F.col("g.gram").alias("gram"))
    votes = rolled.withColumn("hash", F.xxhash64("gram")).join(grams, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left")
    votes = votes.filter((F.col("p") < 0) | F.col("template").isNotNull())
    by_diagonal = votes.groupBy("doc_id", "text_hash", "n_words", "template", "label", "base", "t_words", (F.col("p") - F.col("q")).cast("long").alias("diagonal")).agg(
        F.count(F.when(F.col("p") < 0, 1)).alias("copies"), F.bit_or(F.expr("shiftleft(1L, q)")).alias("hit"), F.min("p").alias("first"), (F.max("p") + k).alias("end")
    )
    per = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    run = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(per) <= gap, 0).otherwise(1)).over(per)
    merged = by_diagonal.withColumn("run", F.when(F.coalesce("base", F.lit(True)), F.col("diagonal")).otherwise(run)).groupBy("doc_id", "text_hash", "n_words", "template", "label", "base", "t_words", "run").agg(
        F.max("copies").alias("copies"), (F.bit_count(F.bit_or("hit")) / (F.col("t_words") - (k - 1))).alias("share"), F.min("first").cast("long").alias("first"), F.max("end").cast("long").alias("end")
    )
    place = F.col("base") & (F.col("share") == 1)
    notice = ~F.col("base") & (F.col("share") >= coverage) & (F.col("end") - F.col("first") <= F.col("t_words") * 1.5 + gap)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = merged.groupBy("doc_id", "text_hash", "n_words").agg(
        F.max("copies").alias("copies"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("first"))).alias("first_word"),
        F.max(F.when(place, F.col("first"))).alias("last_word"),
        joined(F.when(place, F.col("label"))).alias("base_labels"),
        joined(F.when(place | notice, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(place | notice, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(notice, F.struct("first", "end", "label")))), lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
    out = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    return found.select(*out, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*out)
