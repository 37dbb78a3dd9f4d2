"""Licence scan: normalised text units compared to licence templates by the Dice coefficient over word bigrams.

Units are a document's lines and the whole document. A unit is lower-cased and every run of characters outside a-z and 0-9 becomes
one blank; its set holds the distinct bigrams of its words (one word alone stands for itself). Dice = 2 * common / (|A| + |B|)
can reach t only if the smaller set has at least t / (2 - t) times the larger one's size, so a unit looks only at templates within
those bounds, and only at those it shares a bigram with (an equi-join; templates are few and broadcast).
A document in which no unit reaches the threshold is looked at by word windows: as many words as the template has, starting wherever a
bigram they share says that the template would start. So a notice wrapped over lines or with other words on its line is found, too.
Only built-in expressions are used.

Defined results: null or empty text has no units and no licence; ties go to the smaller template id, then to the first unit;
the whole document counts as unit -1 and only if it has several lines; a window counts as unit -2, and n_units then counts windows; rows of one doc_id share their result, each giving a row; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates(spark: SparkSession, texts: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template_id, license, text."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "template_id int, license string, text string")


def normal_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct bigrams of an array of words."""
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(w))


def anchors(sets: list[list[str]], ratio: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template has at least one.

    Such a unit holds at least ratio * |B| of the template's bigrams, so it misses too few to miss all of any |B| - ceil(ratio * |B|) + 1
    of them. Those with the longest words are taken, as such words are rare, and of each the longer word.
    """
    out = set()
    for grams in sets:
        pairs = sorted((-max(map(len, g.split(" "))), g) for g in grams)
        for _, g in pairs[: len(grams) - math.ceil(ratio * len(grams) - 1e-9) + 1]:
            out.add(max(g.split(" "), key=lambda w: (len(w), w)))
    return sorted(out)


def ordered_bigrams(w: Column) -> Column:
    return F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))


def windows(rest: DataFrame, known: DataFrame, min_dice: float) -> DataFrame:
    """id, m (neg, template_id, unit, license), n_units of the documents of rest (doc_id, text) with a window that reaches min_dice."""
    ratio = min_dice / (2 - min_dice)
    t = known.select("template_id", "license", normal_words(F.col("text")).alias("tw")).where(F.size("tw") > 1)
    t = t.select("template_id", "license", F.size("tw").alias("m"), bigrams(F.col("tw")).alias("tb"), ordered_bigrams(F.col("tw")).alias("to"))
    grams = t.select("template_id", F.size("tb").alias("nb"), F.posexplode("to").alias("q", "g"))
    docs = rest.select("doc_id", F.xxhash64("text").alias("uh"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 1)
    hits = docs.select("doc_id", "uh", F.posexplode(ordered_bigrams(F.col("w"))).alias("p", "g")).join(F.broadcast(grams), "g")
    # min_dice takes at least ratio * nb of the template's bigrams.
    both = hits.groupBy("doc_id", "uh", "template_id", "nb").agg(F.countDistinct("g").alias("c"), F.collect_set(F.greatest(F.col("p") - F.col("q"), F.lit(0))).alias("starts"))
    both = both.where(F.col("c") >= F.col("nb") * ratio).withColumnsRenamed({"doc_id": "id", "uh": "h"})
    at = docs.join(both, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("uh") == F.col("h"))).join(F.broadcast(t), "template_id")
    at = at.select("id", "template_id", "license", "tb", "nb", "w", "m", F.explode("starts").alias("start"))
    at = at.select("id", "template_id", "license", "tb", "nb", "start", bigrams(F.slice("w", F.col("start") + 1, F.col("m"))).alias("b"))
    scored = at.withColumn("dice", 2 * F.size(F.array_intersect("b", "tb")) / (F.size("b") + F.col("nb"))).where(F.col("dice") >= min_dice)
    return scored.groupBy("id").agg(F.min(F.struct((-F.col("dice")).alias("neg"), "template_id", F.lit(-2).alias("unit"), "license")).alias("m"), F.countDistinct("start").alias("n_units"))


def scan(docs: DataFrame, known: DataFrame, min_dice: float = 0.75, max_templates: int = 10_000) -> DataFrame:
    """One row per document: doc_id, license, template_id, unit, dice (null where none reaches min_dice), n_units matched.

    `known` (template_id, license, text) is broadcast and must hold at most max_templates rows.
    """
    if known.limit(max_templates + 1).count() > max_templates:
        raise ValueError("too many templates to broadcast")
    t = known.select("template_id", "license", bigrams(normal_words(F.col("text"))).alias("tb")).withColumn("nb", F.size("tb")).where("nb > 0").persist()
    rows = t.select("tb", "nb").collect()  # at most max_templates
    if not rows:
        return docs.select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (("license", "string"), ("template_id", "int"), ("unit", "int"), ("dice", "double"))), F.lit(0).cast("long").alias("n_units"))
    ratio = min_dice / (2 - min_dice)
    lo, hi = min(r["nb"] for r in rows), max(r["nb"] for r in rows)
    known_words = F.array(*map(F.lit, anchors([r["tb"] for r in rows], ratio)))
    split = lambda c: F.split(F.lower(c), "[^a-z0-9]+", -1)
    lines = F.split("text", "\n", -1)
    parts = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array(F.lit(None).cast("string"), F.col("text")))
    # Whole documents without an anchor word go first, then units without one: only the rest is cut into bigrams.
    near = docs.where("text is not null").where(F.arrays_overlap(split(F.col("text")), known_words))
    units = near.select("doc_id", F.posexplode(parts).alias("at", "unit_text")).where(F.length("unit_text") >= int(lo * ratio) + 1)
    units = units.where(F.arrays_overlap(split(F.col("unit_text")), known_words))
    units = units.select("doc_id", F.xxhash64("unit_text").alias("uh"), (F.col("at") - 1).alias("unit"), bigrams(normal_words(F.col("unit_text"))).alias("b"))
    units = units.withColumn("na", F.size("b")).where((F.col("na") >= lo * ratio) & (F.col("na") <= hi / ratio))
    grams = t.select("template_id", "license", "nb", F.explode("tb").alias("g"))
    hits = units.select("doc_id", "uh", "unit", "na", F.explode("b").alias("g")).join(F.broadcast(grams), "g").where((F.col("na") >= F.col("nb") * ratio) & (F.col("nb") >= F.col("na") * ratio))
    scored = hits.groupBy("doc_id", "uh", "unit", "template_id", "license", "na", "nb").agg(F.countDistinct("g").alias("c")).withColumn("dice", 2 * F.col("c") / (F.col("na") + F.col("nb"))).where(F.col("dice") >= min_dice)
    best = scored.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.struct((-F.col("dice")).alias("neg"), "template_id", "unit", "license")).alias("m"), F.countDistinct("unit").alias("n_units"))
    best = best.persist()
    rest = near.select("doc_id", "text").join(best.select("id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")
    best = best.unionByName(windows(rest, known, min_dice))
    out = docs.select("doc_id").join(best, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", "m.license", "m.template_id", "m.unit", (-F.col("m.neg")).alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"))
