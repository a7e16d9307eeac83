"""License scans with DataFrame functions only: MinHash bands over overlapping windows.

Words are lower-cased and stripped of punctuation; a shingle is five words.
A template with m shingles is looked for in windows of w shingles that start at
every d-th shingle, where w is the smallest multiple of d with w >= m + d - 1:
some window then holds every shingle of an occurrence.  A window is retrieved
when one of b bands (one MinHash row each) equals the template's.  For the least
occurrence that counts (a ``CONTAINMENT`` share of the template) the Jaccard
similarity of window and template is at least s, and b is the smallest number
with 1 - (1 - s)^b >= ``RECALL``; templates of three shingles or less are looked
for at every shingle with w = m, where s is 1 and one band is certain.
Retrieved windows are verified by exact containment of the template's shingles.

A window's MinHash equals a template's only if the window holds the shingle that
is the template's minimum under that band.  So the bands are evaluated from there:
one pass marks the positions of such shingles, and the MinHashes of the windows
around them are computed; every other window differs in all bands.

Edge cases: null text and texts under five words have no shingles and no match;
repeated rows are scanned one by one; an empty table gives no rows; very long
texts are read whole; extra columns are kept; a template found in many windows
is reported once, at its best window, ties at the first; templates under
five words are rejected.
"""

from __future__ import annotations

import math
import os
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

NGRAM = 5
CONTAINMENT = (3, 4)
RECALL = 0.999
#: Usual license notices, as published.  Names that share most of their words
#: (GPL, LGPL and AGPL) have templates so short that all or nearly all shingles must be there.
NOTICES = {
    "agpl": "under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at",
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "under the terms of the GNU Lesser General Public License",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Whole license texts, one file each; read on the driver only.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")


def license_texts(folder: str = TEXTS) -> dict:
    """Name -> text of the files in a folder."""
    found = {}
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            found[name.removesuffix(".txt")] = f.read()
    return found


#: What ``scan`` looks for unless templates are given.
TEMPLATES = {**NOTICES, **license_texts()}


def shingles(text: Column) -> Column:
    """Hashes of the five-word sequences of a text."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    w = F.filter(F.split(plain, r"\s+"), lambda x: x != "")
    return let(w, lambda a: F.when(F.size(a) < NGRAM, F.array().cast("array<long>")).otherwise(F.transform(
        F.slice(a, 1, F.size(a) - (NGRAM - 1)),
        lambda x, i: F.xxhash64(x, *[F.get(a, i + j) for j in range(1, NGRAM)]))))


def plan(m: int) -> tuple[int, int, int]:
    """(d, w, b): stride, window and number of bands for a template of m shingles."""
    if m <= 3:
        return 1, m, 1
    d = 2 if m < 15 else max(8, m // 8)
    w = -(-(m + d - 1) // d) * d
    least = -(-m * CONTAINMENT[0] // CONTAINMENT[1])
    s = least / (w + m - least)
    return d, w, math.ceil(math.log(1 - RECALL) / math.log(1 - s))


def template_shingles(spark, templates: dict) -> dict:
    """name -> distinct shingle hashes."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    made = {r["name"]: sorted(set(r["h"])) for r in rows.select("name", shingles(F.col("text")).alias("h")).collect()}
    if not all(made.values()):
        raise ValueError("a template needs at least five words")
    return made


def _longs(values) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def band_minima(spark, templates: dict) -> dict:
    """name -> (salt, shingle, hash) of every band: the template's minimum and its hash in that band.

    A band hashes the shingles anew, so the minima of different bands are independent.
    """
    rng = random.Random(11)
    bands = {n: plan(len(v))[2] for n, v in templates.items()}
    salts = [rng.getrandbits(62) for _ in range(max(bands.values()))]
    rows = spark.createDataFrame(sorted(templates.items()), "name string, h array<long>")
    hashed = rows.select("name", *[F.array_min(F.transform("h", lambda x: F.struct(
        F.xxhash64(x, F.lit(salt)).alias("low"), x.alias("x")))).alias(f"b{i}") for i, salt in enumerate(salts)])
    return {r["name"]: [(salts[i], r[f"b{i}"]["x"], r[f"b{i}"]["low"]) for i in range(bands[r["name"]])]
            for r in hashed.collect()}


def matches(h: Column, templates: dict, minima: dict) -> Column:
    """array<struct<t, start, found>>: verified windows; t numbers the sorted templates."""
    names = sorted(templates)
    plans = [plan(len(templates[n])) for n in names]
    num, den = CONTAINMENT
    # (salt, shingle that is the minimum under the band, its hash there) of each band, for every template
    bands_of = [minima[n] for n in names]
    lowest = [[x for _, x, _ in rows] for rows in bands_of]
    marked = F.filter(F.transform(h, lambda x, i: F.when(
        x.isin(sorted({x for row in lowest for x in row})), i)), lambda i: i.isNotNull())

    def windows(t: int, i: Column) -> Column:
        """Windows around position i that share a band with template t and hold enough of it."""
        d, w, _ = plans[t]
        bands = F.arrays_zip(_longs([salt for salt, _, _ in bands_of[t]]).alias("salt"),
                             _longs([low for _, _, low in bands_of[t]]).alias("low"))
        shingle_set = _longs(templates[names[t]])

        def one(start: Column) -> Column:
            return let(F.slice(h, start + 1, w), lambda part: F.when(
                F.exists(bands, lambda z: F.array_min(F.transform(
                    part, lambda x: F.xxhash64(x, z["salt"]))) == z["low"]),
                F.struct(F.lit(t).alias("t"), start.alias("start"),
                         F.size(F.array_intersect(part, shingle_set)).alias("found"))))

        first = F.greatest(F.ceil((i - (w - 1)) / d), F.lit(0)).cast("int") * d
        starts = F.sequence(first, F.floor(i / d).cast("int") * d, F.lit(d))
        return F.filter(F.transform(starts, lambda start: one(start)),
                        lambda x: x["found"] * den >= len(templates[names[t]]) * num)

    def around(i: Column) -> Column:
        return let(F.get(h, i), lambda x: F.concat(*[
            F.when(x.isin(sorted(set(lowest[t]))), windows(t, i)).otherwise(
                F.array().cast("array<struct<t:int,start:int,found:int>>")) for t in range(len(names))]))

    return F.flatten(F.transform(marked, lambda i: around(i)))


def scan(docs: DataFrame, text: str = "text", templates: dict | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``licenses``: array of (license, start_word, containment).

    One entry per license found, by name; ``start_word`` is the first word of its best window.
    """
    hashed = template_shingles(docs.sparkSession, templates or TEMPLATES)
    names = sorted(hashed)
    labels, sizes = F.split(F.lit("\n".join(names)), "\n"), _longs([len(hashed[n]) for n in names])
    minima = band_minima(docs.sparkSession, hashed)
    found = let(shingles(F.col(text)), lambda h: matches(h, hashed, minima))
    best = let(found, lambda a: F.transform(
        F.array_sort(F.array_distinct(F.transform(a, lambda x: x["t"]))),
        lambda t: let(F.array_max(F.transform(F.filter(a, lambda x: x["t"] == t), lambda x: F.struct(
            x["found"].alias("found"), (-x["start"]).alias("start")))),
            lambda m: F.struct(F.get(labels, t).alias("license"), (-m["start"]).alias("start_word"),
                               (m["found"] / F.get(sizes, t)).alias("containment")))))
    return docs.withColumn("licenses", best)
