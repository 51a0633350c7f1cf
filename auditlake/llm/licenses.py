"""License scans: normalised text against templates by the Dice coefficient over word bigrams, in DataFrame operations only.

The units of a text are its lines, its paragraphs and the whole of it, and windows of words anywhere in it, so that notices
inside other text and those over several lines or paragraphs are found.  Two prunings come first and lose nothing: a unit
must hold one of a few bigrams of each template, of which any match shares at least one, and its number of bigrams must
be within the bounds that the coefficient sets (for windows: repeated ones count, in the template as well).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and texts by SPDX identifier.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission. " + _BSD_END,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES '
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: Percent that the coefficient must reach.
PERCENT = 90
#: Words in a block, in which windows start; each block is read on as far as its windows may reach.
BLOCK_WORDS = 500


def normalised(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(words: Column) -> Column:
    """Distinct word bigrams of an array of words; of a single word, that word."""
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def templates(spark: SparkSession, texts=TEMPLATES) -> DataFrame:
    """(template, license, grams, size)"""
    rows = []
    for i, (name, text) in enumerate(texts):
        w = normalised(text)
        grams = sorted(set(map(" ".join, zip(w, w[1:], strict=False)))) or w
        rows.append((i, name, grams, len(grams)))
    return spark.createDataFrame(rows, "template int, license string, grams array<string>, size int")


def must_have(texts=TEMPLATES, percent: int = PERCENT) -> str:
    """A pattern that every unit with a coefficient of at least `percent` matches, once it is normalised.

    A match shares at least b * t / (2 - t) of a template's b bigrams, so it holds one of any b - that + 1 of them; the
    longest are taken, as those tend to be rare.
    """
    t, out = percent / 100, set()
    for _, text in texts:
        w = normalised(text)
        grams = set(map(" ".join, zip(w, w[1:], strict=False))) or set(w)
        shared = math.ceil(len(grams) * t / (2 - t) - 1e-9)
        out |= set(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - shared + 1])
    return "(?:^| )(?:" + "|".join(sorted(out)) + ")(?: |$)"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def windows(rows: DataFrame, texts=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """(doc_id, unit, unit_size, template, license, size, both) of the matching windows in rows of (doc_id, words).

    A window starts and ends at a template's bigrams and is at most as long as a match may be.  Each start has its best
    window; of windows that share bigrams, those with the highest coefficient stay (then of the largest template).
    """
    listed = []
    for i, (name, text) in enumerate(texts):
        w = normalised(text)
        grams = sorted(set(map(" ".join, zip(w, w[1:], strict=False)))) or w
        reach = max(len(w) - 1, 1) * (200 - percent) // percent
        listed.append((i, name, grams, len(grams), len(w) == 1, -(-len(grams) * percent // (200 - percent)), reach))
    of = "array<struct<template:int,license:string,grams:array<string>,size:int,single:boolean,need:int,reach:int>>"
    each = rows.sparkSession.createDataFrame([(listed,)], f"templates {of}")
    longest = max((t[-1] for t in listed), default=0)

    # A bigram's place, the last place of the same one before it in the block, and whether the template has it.
    by_gram = "array_sort(transform(u, (g, i) -> named_struct('g', g, 'i', i)))"
    mark = "named_struct('i', x.i, 'before', if(get(s, k - 1).g = x.g, get(s, k - 1).i, -1), 'hit', array_contains(t.grams, x.g))"
    marks = _let("s", by_gram, f"array_sort(transform(s, (x, k) -> {mark}))")
    new = "m.before < a.i"
    starts = f"filter(ms, a -> a.hit AND a.i < {BLOCK_WORDS} AND size(filter(slice(ms, a.i + 1, t.reach), m -> m.hit AND {new})) >= t.need)"
    none = "named_struct('n', 0, 'both', 0, 'dice', 0D, 'end', -1, 'best_n', 0, 'best_both', 0)"
    counted = f"named_struct('n', w.n + if({new}, 1, 0), 'both', w.both + if(m.hit AND {new}, 1, 0))"
    matches = f"m.hit AND 200 * v.both >= {percent} * (v.n + t.size) AND 2D * v.both / (v.n + t.size) > w.dice"
    better = "named_struct('n', v.n, 'both', v.both, 'dice', 2D * v.both / (v.n + t.size), 'end', m.i, 'best_n', v.n, 'best_both', v.both)"
    same = "named_struct('n', v.n, 'both', v.both, 'dice', w.dice, 'end', w.end, 'best_n', w.best_n, 'best_both', w.best_both)"
    step = _let("v", counted, f"if({matches}, {better}, {same})")
    window = """named_struct('order', -w.dice, 'larger', -t.size, 'template', t.template, 'start', at + a.i, 'end', at + w.end,
        'words', w.end - a.i + if(t.single, 1, 2), 'unit_size', w.best_n, 'both', w.best_both, 'size', t.size, 'license', t.license)"""
    best = f"transform({starts}, a -> aggregate(slice(ms, a.i + 1, t.reach), {none}, (w, m) -> {step}, w -> if(w.end >= 0, {window}, NULL)))"
    here = _let("u", "if(t.single, b, g)", f"if(size(array_intersect(u, t.grams)) < t.need, NULL, {_let('ms', marks, best)})")
    pairs = "zip_with(slice(b, 1, greatest(size(b) - 1, 0)), slice(b, 2, greatest(size(b) - 1, 0)), (x, y) -> concat(x, ' ', y))"
    block = _let("g", pairs, f"flatten(filter(transform(templates, t -> {here}), f -> f IS NOT NULL))")
    block = _let("at", f"k * {BLOCK_WORDS}", _let("b", f"slice(words, at + 1, {BLOCK_WORDS + longest + 1})", block))
    every = f"filter(flatten(transform(sequence(0, cast((size(words) - 1) div {BLOCK_WORDS} AS int)), k -> {block})), w -> w IS NOT NULL)"
    apart = "aggregate(slice(sorted, 2, size(sorted)), slice(sorted, 1, 1), (c, w) -> if(exists(c, o -> o.start <= w.end AND w.start <= o.end), c, concat(c, array(w))))"
    placed = rows.crossJoin(F.broadcast(each)).select("doc_id", "words", F.expr(f"array_sort({every})").alias("sorted")).where("size(sorted) > 0")
    placed = placed.select("doc_id", "words", F.explode(F.expr(apart)).alias("w"))
    unit = F.expr("array_join(slice(words, w.start + 1, w.words), ' ')").alias("unit")
    return placed.select("doc_id", unit, "w.unit_size", "w.template", "w.license", "w.size", "w.both")


def scan(docs: DataFrame, texts=TEMPLATES, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, dice, n_matches) for each row.

    license: of the unit and template with the highest coefficient (then the longest template, then its first number);
    dice rounded to 6 places; n_matches: distinct units with a match, without windows inside such units.  Null where nothing matches; null and empty texts
    match nothing; repeated rows of an id share their matches; further columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    pattern = must_have(texts, percent)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    clean = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    pieces = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n\n+"), F.array("text")))
    held = rows.where(clean(F.col("text")).rlike(pattern))
    units = held.select("doc_id", F.explode(pieces).alias("unit")).select("doc_id", clean(F.col("unit")).alias("unit"))
    units = units.where(F.col("unit").rlike(pattern)).withColumn("words", F.split("unit", " ")).withColumn("unit_grams", bigrams_of(F.col("words"))).drop("words")
    units = units.withColumn("unit_size", F.coalesce(F.size("unit_grams"), F.lit(0)))
    # Templates are the argument of this function, a few rows: one for each size a match may have.
    sizes = F.expr(f"explode(sequence((size * {percent} + {199 - percent}) div {200 - percent}, (size * {200 - percent}) div {percent}))")
    sized = templates(spark, texts).select("*", sizes.alias("wanted")).withColumn("wanted", F.col("wanted").cast("int"))
    pairs = units.join(F.broadcast(sized), F.col("unit_size") == F.col("wanted")).withColumn("both", F.size(F.array_intersect("unit_grams", "grams")))
    found = pairs.where(200 * F.col("both") >= percent * (F.col("unit_size") + F.col("size")))
    found = found.select("doc_id", "unit", "unit_size", "template", "license", "size", "both")
    inside = windows(held.select("doc_id", F.split(clean(F.col("text")), " ").alias("words")), texts, percent)
    whole = found.select(F.col("doc_id").alias("whole_id"), F.concat(F.lit(" "), "unit", F.lit(" ")).alias("whole"))
    known = F.col("doc_id").eqNullSafe(F.col("whole_id")) & F.contains("whole", F.concat(F.lit(" "), "unit", F.lit(" ")))
    found = found.union(inside.join(whole, known, "left_anti"))
    rank = F.struct((2 * F.col("both") / (F.col("unit_size") + F.col("size"))).alias("dice"), F.col("size"), (-F.col("template")).alias("first"), F.col("license"))
    best = found.groupBy("doc_id").agg(F.max(rank).alias("best"), F.count_distinct(F.sha2("unit", 256)).alias("n_matches"))
    best = best.select(F.col("doc_id").alias("found_id"), F.col("best.license").alias("license"), F.round("best.dice", 6).alias("dice"), "n_matches")
    joined = rows.select("doc_id").join(best, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", "license", "dice", F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"))
