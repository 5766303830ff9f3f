"""License scans by diagonal voting, in Spark's own expressions only.

Every pair of adjacent words in every text is hashed and joined to the positions of the same pair in the license
templates (a small fixed table, so it is broadcast). A hit votes for the diagonal text position - template position.
A short phrase is found where one diagonal gets all its votes; for a longer notice neighbouring diagonals, which
small edits leave, are merged and the span must cover most of the notice's pairs within a bounded length.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, UPPER, whole_text

#: The base phrases, found word for word.
PHRASES = {
    "mit": "mit license",
    "apache": "apache license",
    "gpl": "general public license",
}

#: Sentences of well-known license notices, found with small edits.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

MIN_COVER = 0.8
#: Diagonals at most this far apart are merged.
MAX_SHIFT = 3

#: ASCII that is neither letter nor digit; all else makes up words.
_BREAKS = "".join(c for c in map(chr, range(128)) if not re.match("[0-9A-Za-z]", c))


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and non-ASCII characters, after lower-casing A-Z."""
    plain = F.translate(text, UPPER + _BREAKS, LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " ", -1), "")


def templates() -> list[tuple[int, str, bool, int, int, str, str]]:
    """(template, label, is a base phrase, pairs in all, position, word, next word) for every pair of every template."""
    rows = []
    for k, (label, text, base) in enumerate([(a, t, True) for a, t in PHRASES.items()] + [(a, t, False) for a, t in NOTICES]):
        w = text.split()
        rows += [(k, label, base, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return rows


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_cover: float = MIN_COVER) -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places where a base phrase's words stand one after another; first_word and last_word are their
    least and greatest start, null if there is none. labels adds those of the notices found. score is the largest
    share of a template's word pairs that a verified span covers, 1 for a base phrase and 0 if nothing is found.
    Null text has no words and no labels (empty strings). Null and repeated ids are rows like any other; an empty
    table gives an empty result. Other columns of `docs` are not read."""
    spark = docs.sparkSession
    table = spark.createDataFrame(templates(), "template int, label string, base boolean, pairs int, at int, t0 string, t1 string")
    table = table.withColumn("gram", F.xxhash64("t0", "t1"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(whole_text(text_col)).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("w0"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("w1"))
    placed = texts.select("row", "id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("pos", "p"))
    placed = placed.select("row", "id", "n_words", "pos", F.col("p.w0").alias("w0"), F.col("p.w1").alias("w1")).withColumn("hash", F.xxhash64("w0", "w1"))
    same = (placed["hash"] == table["gram"]) & (placed["w0"] == table["t0"]) & (placed["w1"] == table["t1"])
    hits = placed.join(F.broadcast(table), same, "left").filter("template IS NOT NULL OR pos IS NULL OR pos = 0")  # one row of each text stays
    votes = hits.groupBy("row", "id", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"),
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > MAX_SHIFT) | F.col("base"), F.lit(True))
    merged = votes.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("row", "id", "template", "run").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("pairs").alias("pairs"),
        F.bit_or("seen").alias("seen"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"),
    )
    cover = F.bit_count("seen") / F.col("pairs")
    found = F.when(F.col("base"), cover == 1).otherwise((cover >= min_cover) & (F.col("high") - F.col("low") + 1 <= 1.5 * F.col("pairs")))
    spans = spans.withColumn("cover", cover).withColumn("found", F.coalesce(found, F.lit(False)))
    place = F.col("found") & F.col("base")
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        joined(place).alias("base_labels"),
        joined(F.col("found")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("cover"))), F.lit(0.0)).alias("score"),
    ).withColumnRenamed("id", id_col).drop("row")
