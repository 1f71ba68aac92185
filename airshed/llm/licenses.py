"""License scans (operator 3), in DataFrame functions only.

Templates are license texts and notices.  Documents are cut into overlapping
windows; MinHash bands of a window retrieve templates, and exact shingle
containment over the window confirms them.

* Shingles are ``SHINGLE`` consecutive lower-cased words (letters and digits).
* Class ``w`` (a power of two) holds the templates of at most ``w`` and more
  than ``w / 2`` distinct shingles.  Its windows hold ``3 w / 2`` shingles and
  begin every ``w / 2``, so each occurrence of a template lies whole in one.
* A band is one minimum: the least hash, under the band's seed, of the window's
  shingles, so bands order the shingles independently.  A window with at least ``THRESHOLD`` of a
  template's shingles has Jaccard similarity J > 1/4 with it (0.4 / 1.6 at
  the worst), and more than 1/3 if it holds all.  ``BANDS`` bands miss it
  with probability below 0.75^24 = 0.1 % (0.67^24 = 0.006 %).
* Verification: the share of the template's distinct shingles that the window
  holds is at least ``THRESHOLD``.

A band's minimum can equal a template's only in a window that holds the
shingle which gives that minimum; windows without any such shingle are passed
over before their minima are taken, which loses no collision.

Defined results: null, empty and too short texts match nothing; repeated rows
match alike (one row per id and license); only the id is carried over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
BANDS = 24
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    license_id: str
    text: str


# Public license notices.
TEMPLATES = (
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("reserved", "All rights reserved."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("MIT", "Released under the MIT License."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                    "furnished to do so, subject to the following conditions"),
    Template("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the "
                           "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                           "KIND, either express or implied."),
    Template("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met"),
    Template("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                    "GNU General Public License as published by the Free Software Foundation"),
    Template("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                    "fee is hereby granted, provided that the above copyright notice and this permission notice "
                    "appear in all copies."),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                             "License."),
)


_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NONE = "array<bigint>"


def _shingled(df: DataFrame, text: str, into: str) -> DataFrame:
    """Codes of every run of three words; projected step by step so that no array is computed twice."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), _GAP), lambda w: w != "")

    def paired(a: str, b: str, shift: int, size: Column) -> Column:
        return F.when(size > 0, F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1 + shift), size),
                                           lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast(_NONE))

    df = df.withColumn("__w1", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("__w2", paired("__w1", "__w1", 1, F.size("__w1") - 1))
    return df.withColumn(into, paired("__w2", "__w1", 2, F.size("__w1") - 2)).drop("__w1", "__w2")


def _minimum(codes: str | Column, band: int | Column) -> Column:
    """Least hash of the codes under the band's seed."""
    return F.array_min(F.transform(codes, lambda x: F.xxhash64(x, band)))


def _class(n: int) -> tuple[int, int, int]:
    """(class, step, window) of a template with n distinct shingles."""
    w = 1 << (n - 1).bit_length()
    step = max(1, w // 2)
    return w, step, 3 * step if w > 1 else 1


@dataclass(frozen=True)
class Prepared:
    rows: list[tuple[str, int, int, list[int], list[int]]]  # license, number, class, shingles, minima
    classes: list[tuple[int, int, int]]
    signs: list[int]  # shingles that give some minimum


def prepare(spark: SparkSession, templates=TEMPLATES, bands: int = BANDS) -> Prepared:
    """Shingles and minima of the templates (as many rows as the list has)."""
    df = spark.createDataFrame([(i, t.license_id, t.text) for i, t in enumerate(templates)],
                               "number int, license_id string, text string")
    rows, classes, signs = [], set(), set()
    hashed = F.transform("s", lambda x: F.struct(x.alias("code"), F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda z: F.xxhash64(x, z)).alias("h")))
    known = _shingled(df, "text", "s").select("number", "license_id", F.array_distinct("s").alias("s"))
    for r in known.withColumn("hashed", hashed).collect():
        if not r["s"]:
            raise ValueError(f"template {r['number']} has fewer than {SHINGLE} words")
        best = [min((x["h"][z], x["code"]) for x in r["hashed"]) for z in range(bands)]
        classes.add(_class(len(r["s"])))
        signs.update(code for _, code in best)
        rows.append((r["license_id"], r["number"], _class(len(r["s"]))[0], r["s"], [h for h, _ in best]))
    return Prepared(rows, sorted(classes), sorted(signs))


def _windows(places: str, w: int, step: int, size: int) -> Column:
    """(class, start, size) of each window of a class that holds one of the places."""
    def around(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((p - (size - step)) / step)).cast("int"),
                          F.floor(p / step).cast("int"))

    def window(k: Column) -> Column:
        return F.struct(F.lit(w).alias("w"), (k * step).alias("start"), F.lit(size).alias("size"))

    return F.transform(F.array_distinct(F.flatten(F.transform(places, around))), window)


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text",
         bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license_id, containment, n_windows): best share and number of matching windows per id and license."""
    known = prepare(spark, templates, bands)
    df = _shingled(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")), "t", "s").drop("t")
    places = F.filter(F.transform("s", lambda x, i: F.when(x.isin(*known.signs), i)), lambda i: i.isNotNull())
    df = df.withColumn("p", places)
    df = df.select("id", "s", F.explode_outer(F.concat(*[_windows("p", *c) for c in known.classes])).alias("v")) \
        .where("v is not null")
    df = df.select("id", "v.w", "v.start", F.array_distinct(F.slice("s", F.col("v.start") + 1, F.col("v.size")))
                   .alias("held"))
    minima = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda z: _minimum("held", z))
    found = df.withColumn("m", minima).select("id", "w", "start", "held", F.posexplode("m").alias("band", "value"))
    signatures = spark.createDataFrame(
        [(n, w, b, v) for _, n, w, _, m in known.rows for b, v in enumerate(m)],
        "number int, w int, band int, value long")
    # one row per template and band: as many as the template list says
    met = found.join(F.broadcast(signatures), ["w", "band", "value"]) \
        .select("id", "start", "held", "number").dropDuplicates(["id", "start", "number"])
    shingles = spark.createDataFrame([(n, lic, s) for lic, n, _, s, _ in known.rows],
                                     "number int, license_id string, shingles array<long>")
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    return (met.join(F.broadcast(shingles), "number").withColumn("share", share).where(F.col("share") >= threshold)
            .groupBy("id", "license_id").agg(F.max("share").alias("containment"),
                                             F.countDistinct("number", "start").alias("n_windows")))
