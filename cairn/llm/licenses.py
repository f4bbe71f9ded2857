"""License scans by MinHash bands over overlapping windows, with DataFrame operations only.

Texts and templates become sequences of five-word shingles. Windows of
shingles overlap; each has minima under HASHES random maps, and every minimum is
a band of one row, so that windows of similarity s meet with chance
1 - (1 - s)^HASHES. Two window widths keep s high for every template: a template
of one or two shingles meets windows of two (s >= 1/2, chance above 0.9999), a
longer one windows of eight, half overlapping, that hold at least three to five
of its shingles (s >= 3/8, chance above 0.9994). A band that agrees gives a
candidate: template and place. There the exact share of the template's shingles
found in the text around is counted, and must be ``percent`` or more.

Two windows without a common shingle can't agree, so windows are made only where
a shingle of some template lies; those places are found in one pass over all
texts without a shuffle. The template side is a fixed parameter table and is
broadcast after a check of its size.

Templates of fewer than five words are one shingle of their own length, looked for
exactly.

Cases: null and empty texts have no shingles and no rows; very long texts are
read whole; a text may match several templates, and of places that tie the first
is given; an empty table gives no rows; other columns of docs are not read; rows that repeat a doc_id are reported once; rows
without doc_id have no name to be reported by and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.shared import cut, id_text, small

WORDS, HASHES = 5, 16
#: Shingles of a window and steps between windows, for templates with at most SHORT shingles and for others.
WIDTHS, STEPS, SHORT = (2, 8), (1, 4), 2
BROADCAST_ROWS = 200_000

#: Public license notices and openings of public license texts.
TEMPLATES = {
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-notice": "Released under the MIT License",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def shingled(rows: DataFrame, *keep: str) -> DataFrame:
    """keep and sh: hashes of the runs of WORDS words of the text, in order."""
    rows = rows.select(*keep, F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), "").alias("_words"))
    starts = F.sequence(F.lit(0), F.size("_words") - WORDS)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WORDS)]))  # a slice would read the whole array each time
    return rows.select(*keep, F.when(F.size("_words") >= WORDS, runs).otherwise(F.array().cast("array<bigint>")).alias("sh"))


def short_found(docs: DataFrame, templates: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows as licenses_found() gives for templates of ``lengths`` words, all under WORDS: each is one run of words."""
    words = lambda rows, *keep: rows.select(*keep, F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), "").alias("w"))
    run = lambda n: lambda i: F.xxhash64(F.lit(n), *[F.get("w", i + k) for k in range(n)])
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(run(n)(i).alias("key"), i.alias("place"))))
    known = words(templates, "license").select("license", F.coalesce(*[F.when(F.size("w") == n, run(n)(F.lit(0))) for n in lengths]).alias("key")).where("key is not null")
    arrays = [F.coalesce(runs(n), F.array().cast("array<struct<key:bigint,place:int>>")) for n in lengths]
    hits = words(docs, "doc_id").select("doc_id", F.inline(F.concat(*arrays))).join(small(known), "key")
    return hits.groupBy("doc_id", "license").agg(F.lit(1).alias("matched"), F.lit(1).alias("shingles"), F.min("place").alias("place"))


def bands(window: Column) -> Column:
    """Minima of a window under each random map, with the map's number."""
    return F.array(*[F.struct(F.lit(j).alias("band"), F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(j)))).alias("low")) for j in range(HASHES)])


def windows(places: Column, k: int) -> Column:
    """Starts (0-based) of windows of width k that cover places, without those before the text."""
    offsets = F.array(*[F.lit(STEPS[k] * i) for i in range(WIDTHS[k] // STEPS[k])])
    starts = F.flatten(F.transform(places, lambda p: F.transform(offsets, lambda o: p - F.pmod(p, F.lit(STEPS[k])) - o)))
    return F.transform(F.filter(F.array_distinct(starts), lambda s: s >= 0), lambda s: F.struct(F.lit(k).alias("width"), s.alias("start")))


def licenses_found(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, percent: int = 80) -> DataFrame:
    """doc_id, license, matched and shingles (of the template) and place (first word of the best window)."""
    spark: SparkSession = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(list((templates or TEMPLATES).items()), "license string, text string")
    n_words = F.size(F.array_remove(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+"), ""))
    short = sorted(r.n for r in templates.select(n_words.alias("n")).distinct().where(f"n between 1 and {WORDS - 1}").collect())  # at most four lengths
    known = shingled(templates, "license").withColumn("own", F.array_distinct("sh"))
    known = cut(known.where(F.size("sh") > 0).withColumn("width", F.when(F.size("sh") <= SHORT, 0).otherwise(1)))
    all_starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("sh") - F.when(F.col("width") == 0, WIDTHS[0]).otherwise(WIDTHS[1]) + 1))
    parts = known.select("license", "width", "sh", F.explode(all_starts).alias("s"))
    parts = parts.select("license", "width", F.inline(bands(F.slice("sh", F.col("s"), F.when(F.col("width") == 0, WIDTHS[0]).otherwise(WIDTHS[1])))))
    parts = cut(parts.distinct())
    marks = cut(known.select(F.explode("own").alias("key")).distinct())
    if parts.count() <= BROADCAST_ROWS and marks.count() <= BROADCAST_ROWS:
        known, parts, marks = F.broadcast(known), F.broadcast(parts), F.broadcast(marks)

    all_shingles = shingled(id_text(docs).where("doc_id is not null"), "doc_id")
    # written as one transform: of a plain array column the optimizer tests the size first, below, with all that made it written out again
    each = F.explode(F.transform("sh", lambda k, i: F.struct(k.alias("key"), i.alias("place")))).alias("s")
    hits = all_shingles.select("doc_id", each).select("doc_id", "s.key", "s.place").join(marks, "key", "left_semi")
    places = cut(hits.groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    narrow = places.select("doc_id")
    if places.count() <= 5 * BROADCAST_ROWS:
        narrow = F.broadcast(narrow)
    texts = cut(shingled(id_text(docs).join(narrow, "doc_id", "left_semi"), "doc_id"))

    at = places.select("doc_id", F.explode(F.concat(windows(F.col("places"), 0), windows(F.col("places"), 1))).alias("w")).select("doc_id", "w.width", "w.start")
    size = F.when(F.col("width") == 0, WIDTHS[0]).otherwise(WIDTHS[1])
    found = texts.join(at, "doc_id").select("doc_id", "width", "start", F.filter(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get("sh", F.col("start") + i)), lambda x: x.isNotNull()).alias("window")).where(F.size("window") > 0)
    found = found.select("doc_id", "width", "start", F.inline(bands(F.col("window"))))
    candidates = cut(found.join(parts, ["width", "band", "low"]).select("doc_id", "license", "start").distinct())

    near = texts.join(candidates, "doc_id").join(known.select("license", "own"), "license")
    low = F.greatest(F.lit(0), F.col("start") - F.size("own"))
    region = F.slice("sh", low + 1, F.col("start") - low + WIDTHS[1] + F.size("own"))
    near = near.select("doc_id", "license", F.col("start").alias("place"), F.size(F.array_intersect("own", region)).alias("matched"), F.size("own").alias("shingles"))
    near = near.where(F.col("matched") * 100 >= F.col("shingles") * percent)
    best = F.max(F.struct("matched", (-F.col("place")).alias("minus"), "shingles")).alias("best")
    out = near.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "best.matched", "best.shingles", (-F.col("best.minus")).alias("place"))
    return out.unionByName(short_found(id_text(docs).where("doc_id is not null"), templates, short)) if short else out
