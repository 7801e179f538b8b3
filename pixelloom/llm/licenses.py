"""License scans (native): MinHash bands over overlapping windows, then exact containment.

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words. For each
template, windows of the power of two that is at least twice its shingles overlap by half, so
that any occurrence lies whole in a window. A window and a template meet when one of
``BANDS`` min-hashes (one row each, xor permutations of 64-bit shingle hashes) agree; then at
least ``CONTAINED`` of the template's distinct shingles must be in the window.

Chance to meet: 1 - (1 - J)^32 for Jaccard similarity J. A whole template has J of at least
1/4, so 0.9999; one of which exactly 75 % is left has at least 0.17, so 0.997.

A window can only agree with a template if it holds the very shingle that is the template's
least under that permutation. So documents without any such shingle are dropped right after
hashing, and windows without one before they are unrolled; neither loses a match.

Defined results: null, empty and short texts have no matches. Each document row that matches a
template gives one row: the best window's share, the earliest on ties. Rows alike in doc_id and text
give one row per template together; rows of a null or repeated doc_id with texts of their own give
their own. Only the tables of templates and their bands are collected or broadcast; both are bounded by
the number of templates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import bind

SHINGLE, BANDS, CONTAINED = 5, 32, 0.75

# Texts of public licenses and notices.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT line": "Released under the MIT License",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def masks(bands: int = BANDS) -> list[int]:
    """Permutations: signed 64-bit xor masks whose high bits are spread evenly."""
    rng = np.random.default_rng(20)
    low = rng.integers(0, 2**58, bands, dtype=np.uint64)
    high = (np.arange(bands, dtype=np.uint64) * np.uint64(64 // bands if bands <= 64 else 1) % np.uint64(64)) << np.uint64(58)
    return (low | high).view(np.int64).tolist()


def shingle_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any other character beyond ASCII."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hashes of all ``n``-word shingles of an array column of words, in order."""

    def hashes(w):
        own = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, own).otherwise(F.array().cast("array<bigint>"))

    return bind(words, hashes)


def _windows(hashes: Column, width: int, seeds: list[int]) -> Column:
    """Structs (width, start, grams) of the windows that hold one of ``seeds``."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(max(1, width // 2)))
    cut = F.transform(starts, lambda i: F.struct(F.lit(width).alias("width"), i.alias("start"), F.slice(hashes, i + 1, F.lit(width)).alias("grams")))
    return F.filter(cut, lambda x: F.exists(x["grams"], lambda g: g.isin(seeds)))


def _least(grams: str, mask: int) -> Column:
    return F.array_min(F.transform(grams, lambda g: g.bitwiseXOR(F.lit(mask).cast("long"))))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, n_found and n_shingles (of the template), first_word (of the window)."""
    spark = docs.sparkSession
    hashed = lambda df: df.withColumn("h", shingle_hashes(shingle_words(F.col("text")))).drop("text")
    known = hashed(spark.createDataFrame(list(templates.items()), "license string, text string")).collect()  # one row a template
    if short := [r.license for r in known if not r.h]:
        raise ValueError(f"templates with fewer than {SHINGLE} words: {short}")
    own_masks = masks(bands)
    scales: dict[int, list] = {}
    for r in known:
        grams = sorted(set(r.h))
        width = 1 << (2 * len(r.h) - 1).bit_length()
        least = [int((np.array(grams, np.int64) ^ m).min()) for m in own_masks]
        scales.setdefault(width, []).append((r.license, grams, least))
    seeds = {w: sorted({v ^ m for _, _, least in ts for v, m in zip(least, own_masks, strict=True)}) for w, ts in scales.items()}
    every = sorted({s for x in seeds.values() for s in x})

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    d = hashed(d).where(F.exists("h", lambda x: x.isin(every)))
    windows = bind(F.col("h"), lambda h: F.concat(*(_windows(h, width, seed) for width, seed in seeds.items())))
    found = d.select("doc_id", "own", F.explode(windows).alias("w")).select("doc_id", "own", "w.*")
    least = F.array(*(_least("grams", m) for m in own_masks))
    met = found.select("doc_id", "own", "width", "start", "grams", F.posexplode(least).alias("band", "least"))
    table = spark.createDataFrame([(w, b, v, name) for w, ts in scales.items() for name, _, vs in ts for b, v in enumerate(vs)], "width int, band int, least long, license string")
    grams = spark.createDataFrame([(name, g) for ts in scales.values() for name, g, _ in ts], "license string, template array<bigint>")
    # Bounded by the templates: bands rows each, and their shingles.
    pairs = met.join(F.broadcast(table), ["width", "band", "least"]).join(F.broadcast(grams), "license")
    n = F.size(F.array_intersect("grams", "template"))
    pairs = pairs.select("doc_id", "own", "license", "start", n.cast("long").alias("n_found"), F.size("template").cast("long").alias("n_shingles"))
    pairs = pairs.where(F.col("n_found") >= F.lit(contained) * F.col("n_shingles"))
    best = F.max_by(F.struct("n_found", "start"), F.struct("n_found", -F.col("start")))
    out = pairs.groupBy("doc_id", "own", "license").agg(best.alias("best"), F.max("n_shingles").alias("n_shingles"))
    return out.select("doc_id", "license", "best.n_found", "n_shingles", F.col("best.start").cast("long").alias("first_word"))
