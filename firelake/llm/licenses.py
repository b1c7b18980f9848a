"""License scans: MinHash bands over overlapping windows find templates, containment confirms them.

Words are maximal runs of letters and digits, lower-cased. A template's shingles are its runs of
five words; templates with fewer words are left out. Texts are cut into windows of twice a
template's length, one set of windows for each template length, each beginning half a length after
the one before; so a passage as long as a template lies in one window whole.

A window gets bands of minima over its shingles' hashes and meets the templates with which it shares
a band. A window that holds 75 of 100 shingles of a template has a known least similarity with it;
`band_settings` takes as many bands as are needed to meet with the wanted probability (0.999) there.
Every meeting is then confirmed on the shingles themselves. Windows without any shingle of a
template can meet none, so their minima are not computed.

The result has one row per document and license: the best containment and the first word (from 1)
of the window that has it, the earliest of several.
Null and empty texts match nothing; without templates nothing does. Rows without doc_id are reported
under null; repeated rows give one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = 75
COLLISION = 0.999

# Notices by which licenses are given.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
}
NOT_WORD = r"[^\p{L}\p{N}]+"


class Bands(NamedTuple):
    bands: int
    rows: int


def band_settings(similarity: float, chance: float = COLLISION, most_hashes: int = 128) -> Bands:
    """The most selective bands that still meet with the wanted chance: 1 - (1 - s ** rows) ** bands."""
    for rows in range(8, 0, -1):
        bands = math.ceil(math.log(1 - chance) / math.log(1 - similarity**rows))
        if bands * rows <= most_hashes or rows == 1:
            return Bands(bands, rows)
    raise AssertionError("one row always fits")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _shingle(words: str, place: str) -> str:
    return f"xxhash64(slice({words}, {place}, {SHINGLE_WORDS}))"


def _shingles(words: str) -> str:
    """SQL for the hashes of the distinct runs of five words."""
    places = f"sequence(1, size({words}) - {SHINGLE_WORDS - 1})"
    return f"array_distinct(transform({places}, i -> {_shingle(words, 'i')}))"


def _bands(shingles: str, settings: Bands) -> str:
    """SQL for one hash per band: of the minima of its rows over the shingles."""
    least = f"array_min(transform({shingles}, s -> xxhash64(s, b * {settings.rows} + r)))"
    rows = f"transform(sequence(0, {settings.rows - 1}), r -> {least})"
    return f"transform(sequence(0, {settings.bands - 1}), b -> xxhash64(b, {rows}))"


def _among(shingles: Iterable[int]) -> str:
    return "(" + ", ".join(f"{s}L" if s > -(1 << 63) else "-9223372036854775807L - 1L" for s in sorted(shingles)) + ")"


def least_similarity(lengths: Sequence[int]) -> float:
    """Smallest Jaccard similarity of a template of one of these lengths and a window that holds enough of it."""

    def of(n: int) -> float:
        own, window = n - SHINGLE_WORDS + 1, 2 * n - SHINGLE_WORDS + 1
        shared = math.ceil(CONTAINMENT / 100 * own)
        return shared / (window + own - shared)

    return min(map(of, lengths))


def window_step(length: int) -> int:
    return max(1, length // 2)


def _windows(length: int, wanted: Iterable[int]) -> str:
    """SQL for the windows (length, first, shingles) for templates of one length that a wanted shingle lies in."""
    step = window_step(length)
    low = f"greatest(0, CAST(ceil((i - 1 + {SHINGLE_WORDS - 2 * length}) / {step}) AS INT))"
    around = f"sequence({low}, CAST(floor((i - 1) / {step}) AS INT))"
    own = f"filter(hits, i -> {_shingle('words', 'i')} IN {_among(wanted)})"
    starts = f"array_distinct(flatten(transform({own}, i -> {around})))"
    window = f"slice(words, v * {step} + 1, {2 * length})"
    # A list of one names the window, so it is cut once.
    shingles = f"transform(array({window}), x -> {_shingles('x')})[0]"
    return f"transform({starts}, v -> struct({length} AS length, v * {step} + 1 AS first, {shingles} AS shingles))"


def _once(value: str, name: str) -> Column:
    """A generated column: it is computed once per row, and filters on it stay above."""
    return F.explode(F.array(F.expr(value))).alias(name)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word) of each license that a text of `docs(doc_id, text)` gives.

    The templates are a parameter: their shingles become constants of the plan.
    """
    spark = docs.sparkSession
    notices = spark.createDataFrame(sorted(templates.items()), "license string, notice string")
    words = notices.select("license", _words(F.col("notice")).alias("words")).where(F.size("words") >= SHINGLE_WORDS)
    known = words.select("license", F.size("words").alias("length"), F.expr(_shingles("words")).alias("template"))
    listed = known.collect()
    if not listed:
        nothing = docs.select("doc_id").where(F.lit(False))
        return nothing.selectExpr("doc_id", "'' AS license", "0D AS containment", "0 AS first_word")
    wanted = {n: {s for r in listed if r["length"] == n for s in r["template"]} for n in {r["length"] for r in listed}}
    settings = band_settings(least_similarity([*wanted]))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", F.explode(F.array(_words(text))).alias("words")).where(F.size("words") >= SHINGLE_WORDS)
    # Places of template shingles; a text without any ends here.
    places = f"sequence(1, size(words) - {SHINGLE_WORDS - 1})"
    hits = f"filter({places}, i -> {_shingle('words', 'i')} IN {_among(set().union(*wanted.values()))})"
    found = texts.select("doc_id", "words", _once(hits, "hits")).where(F.size("hits") > 0)
    cuts = ", ".join(_windows(n, wanted[n]) for n in sorted(wanted))
    windows = found.select("doc_id", F.expr(f"explode(flatten(array({cuts})))").alias("w")).select("doc_id", "w.*")

    met = windows.withColumn("band", F.expr(f"explode({_bands('shingles', settings)})"))
    bands = known.withColumn("band", F.expr(f"explode({_bands('template', settings)})"))
    pairs = met.join(bands, ["length", "band"])
    shared = F.size(F.array_intersect("shingles", "template"))
    pairs = pairs.withColumn("shared", shared).where(100 * F.col("shared") >= CONTAINMENT * F.size("template"))
    best = F.struct(F.col("shared"), (-F.col("first")).alias("later"))
    found = pairs.groupBy("doc_id", "license").agg(F.max(best).alias("best"), F.first(F.size("template")).alias("size"))
    return found.select(
        "doc_id", "license", (F.col("best.shared") / F.col("size")).alias("containment"), (-F.col("best.later")).alias("first_word")
    )
