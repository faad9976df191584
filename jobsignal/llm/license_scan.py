"""Licence scan: normalised units of a text against licence templates by Dice coefficient over word bigrams.

Both sides are lower-cased and cut to words of letters, digits and dots. Units are a text's lines, its paragraphs
(between lines without words) and the whole text. With n distinct bigrams in a unit and m in a template, Dice is
2 * common bigrams / (n + m); since the common ones are at most min(n, m), a unit is compared only with templates whose
size lies within bounds that the threshold sets. Bigrams are compared by 64-bit hashes. Everything is
a projection of DataFrame functions: no shuffle, no Python.

Templates are short notices, below, and whole licences, read on the driver from the files of a folder that are named by
licence id. A unit's licence is that of its best template, as versions of a licence resemble each other.

Defined results: null and empty texts have no units that match; a text with several matching units reports the licences
of all and the best value; ties of a unit's or a text's best value go to all and to the smaller licence id; repeated
rows each return a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Whole licence texts, a file each.
FOLDER = Path(__file__).parent / "licenses"

# Public licence notices and texts.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def templates_of(folder: str | Path = FOLDER, notices=NOTICES) -> tuple[tuple[str, str], ...]:
    """(licence id, text) of the notices and of the folder's files."""
    return (*notices, *((f.stem, f.read_text("utf-8")) for f in sorted(Path(folder).glob("*.txt"))))


def words_of(text: str) -> list[str]:
    """The words of a template, cut as the columns of documents are."""
    return re.sub(r"[^a-z0-9.]+", " ", text.lower()).strip().split(" ")


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def size_bounds(m: int, percent: int) -> tuple[int, int]:
    """Least and most distinct bigrams of a unit that can reach the threshold with a template of m."""
    return -(-percent * m // (200 - percent)), (200 - percent) * m // percent


def _hash(bigram: str) -> int:
    """What Spark's xxhash64 gives for the two words of a bigram."""
    seed = 42
    for word in bigram.split(" "):
        seed = xxhash.xxh64_intdigest(word.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _dice(grams, n, template: list[str], percent: int):
    m = len(template)
    lo, hi = size_bounds(m, percent)
    hashes = F.split(F.lit("|".join(str(_hash(g)) for g in template)), r"\|").cast("array<bigint>")
    return F.when(n.between(lo, hi), 2.0 * F.size(F.array_intersect(grams, hashes)) / (n + F.lit(m)))


def scan_licenses(docs: DataFrame, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_matches, licenses, best_license, best_dice), a row per row of docs.

    ``templates``: pairs of licence id and text; by default those of ``templates_of()``.
    """
    templates = templates or templates_of()
    percent = round(100 * threshold)
    shapes = [(name, list(dict.fromkeys(bigrams_of(text)))) for name, text in templates]
    low = min(size_bounds(len(g), percent)[0] for _, g in shapes)  # a unit of fewer bigrams, repeats counted, matches none
    # one pass normalises the text; after it, words stand apart by one space or line break, so sizes are cheap to count
    flat = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}.\n]+", " ")
    flat = F.replace(F.replace(flat, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    whole = F.regexp_replace("t", r"\n+", " ")
    paragraphs = F.transform(F.split("t", r"\n\n+"), lambda u: F.replace(u, F.lit("\n"), F.lit(" ")))
    units = F.array_distinct(F.transform(F.concat(F.split("t", r"\n"), paragraphs, F.array(whole)), lambda u: F.trim(u)))
    gaps = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, w[i + 1]))
    text = docs.select("doc_id", flat.alias("t"))
    cut = text.select("doc_id", F.transform(F.filter(units, lambda u: gaps(u) >= low), lambda u: F.split(u, " ")).alias("w"))
    grams = cut.select("doc_id", F.transform("w", lambda w: F.array_distinct(pairs(w))).alias("g"))

    def scored(g):
        n = F.size(g)
        dices = F.array(*(F.struct(_dice(g, n, t, percent).alias("dice"), F.lit(name).alias("license")) for name, t in shapes))
        return F.filter(dices, lambda x: x["dice"] >= percent / 100)

    best_of = lambda u: F.filter(u, lambda x: x["dice"] == F.array_max(u)["dice"])
    hits = grams.select("doc_id", F.transform("g", scored).alias("u")).select("doc_id", F.transform("u", best_of).alias("u"))
    matched = F.size(F.filter("u", lambda x: F.size(x) > 0))
    flat = hits.select("doc_id", matched.cast("long").alias("n_matches"), F.flatten("u").alias("h"))
    top = F.array_max(F.transform("h", lambda x: x["dice"]))
    best = F.array_min(F.transform(F.filter("h", lambda x: x["dice"] == top), lambda x: x["license"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("h", lambda x: x["license"]))), ",")
    return flat.select("doc_id", "n_matches", names.alias("licenses"), best.alias("best_license"), F.round(top, 6).alias("best_dice"))


def oracle_sql(templates=None, threshold: float = THRESHOLD) -> str:
    """The same over DuckDB's table documents."""
    templates = templates or templates_of()
    percent = round(100 * threshold)
    rows = ", ".join(f"('{name}', '{' '.join(words_of(text))}')" for name, text in templates)
    return f"""
WITH told AS (SELECT license, string_split(t, ' ') AS w FROM (VALUES {rows}) AS x(license, t)),
templates AS (SELECT license, len(gs) AS m, gs FROM (SELECT license, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gs FROM told)),
flat AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}.\\n]+', ' ', 'g') AS t FROM documents),
docs AS (SELECT r, doc_id, replace(replace(t, ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)) AS t FROM flat),
units AS (
  SELECT DISTINCT r, trim(u) AS u FROM (
    SELECT r, unnest(string_split(t, chr(10))) AS u FROM docs
    UNION ALL SELECT r, replace(unnest(regexp_split_to_array(t, '\\n\\n+')), chr(10), ' ') FROM docs
    UNION ALL SELECT r, regexp_replace(t, '\\n+', ' ', 'g') FROM docs)),
words AS (SELECT r, u, string_split(u, ' ') AS w FROM units),
grams AS (SELECT r, u, len(b) AS n, b FROM (SELECT r, u, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words WHERE len(w) > 1)),
hits AS (
  SELECT r, u, license, 2.0 * len(list_intersect(b, gs)) / (n + m) AS dice
  FROM grams JOIN templates ON n * {percent} <= (200 - {percent}) * m AND m * {percent} <= (200 - {percent}) * n),
good AS (SELECT * FROM hits WHERE dice >= {percent} / 100.0 QUALIFY dice = max(dice) OVER (PARTITION BY r, u)),
per AS (
  SELECT r, count(DISTINCT u) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(dice) AS best
  FROM good GROUP BY r),
top AS (SELECT per.r, min(license) AS best_license FROM per JOIN good ON per.r = good.r AND good.dice = per.best GROUP BY per.r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, round(best, 6) AS best_dice
FROM docs LEFT JOIN per USING (r) LEFT JOIN top USING (r)
"""
