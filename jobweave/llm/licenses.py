"""Licence scan, in DataFrame operations only.

A document's units (its lines, its paragraphs, the whole text) are normalised and compared with licence templates by the Dice coefficient
of their distinct word bigrams. A coefficient of t needs |A| between |B| * t / (2 - t) and |B| * (2 - t) / t, so a
unit meets only the templates whose size range holds its own: an equi-join on size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_BROADCAST = 32 << 20  # bytes of templates and size ranges that are broadcast; more are joined by shuffling, salted
SALTS = 32
MAX_MARKS = 20_000  # necessary words that are looked up inside the scan; with more of them, every document is compared

#: Public licence texts and notices (identifier, text).
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
TEMPLATES = (
    ("MIT", _MIT_GRANT + " " + _WARRANTY),
    ("MIT", _MIT_GRANT),
    ("MIT", _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-2-Clause", _BSD_GRANT + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + " " + _BSD_NAMES + " " + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", _GPL.format("", "2")),
    ("GPL-3.0", _GPL.format("", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _GPL.format("Lesser ", "3")),
    ("AGPL-3.0", _GPL.format("Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bigrams(words: Column) -> Column:
    """Distinct neighbours; the words are bound to a lambda's variable, and so computed once."""
    pairs = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i))))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(words), pairs), F.lit(0))


def templates(spark: SparkSession, listed=TEMPLATES) -> DataFrame:
    """license, template (number), b (bigrams), nb."""
    rows = spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(listed)], "template int, license string, text string")
    return rows.select("license", "template", _bigrams(words_of(F.col("text"))).alias("b")).withColumn("nb", F.size("b")).where("nb > 0")


def necessary_words(known: DataFrame, threshold: float) -> list[str]:
    """Words of which a text that meets a template has one. Two bigram sets meet only if they share nb * t / (2 - t) of a
    template's, so any nb less that, plus one, hold a shared one: here those with the longest words, and of each its longer word."""
    words = set()
    for row in known.select("nb", "b").collect():
        spare = row["nb"] - math.ceil(row["nb"] * threshold / (2 - threshold) - 1e-9) + 1
        longest = [max(b.split(" "), key=lambda w: (len(w), w)) for b in row["b"]]
        words.update(sorted(longest, key=lambda w: (-len(w), w))[:spare])
    return sorted(words)


def licence_hits(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per unit that meets a template: doc_id, unit (text), license, template, dice; units equal to
    another unit of their document are compared once, and of a unit's templates the best stays (ties: the first)."""
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    span = known.select("template", F.explode(F.sequence(F.ceil(F.col("nb") * (threshold / (2 - threshold)) - 1e-9).cast("int"), F.floor(F.col("nb") * ((2 - threshold) / threshold) + 1e-9).cast("int"))).alias("na"))
    top = known.agg(F.max(F.floor(F.col("nb") * ((2 - threshold) / threshold) + 1e-9))).first()[0]
    text = F.coalesce("text", F.lit(""))
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    least = known.agg(F.min(F.ceil(F.col("nb") * (threshold / (2 - threshold)) - 1e-9))).first()[0]
    if top is None:
        return docs.select("doc_id", F.col("text").alias("unit"), F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("dice")).where("false")
    # A document without any necessary word has no unit that meets a template.
    marks = necessary_words(known, threshold)
    if len(marks) <= MAX_MARKS:
        docs = docs.where(F.exists(words_of(text), lambda w: w.isin(*marks)))
    # All inside one expression, so that each unit is cut into words once; units of a size that no template meets go at once.
    cut = F.filter(F.transform(parts, lambda u: F.struct(u.alias("unit"), _bigrams(words_of(u)).alias("a"))), lambda x: (F.size(x["a"]) >= int(least)) & (F.size(x["a"]) <= int(top)))
    units = docs.select("doc_id", F.explode(cut).alias("u")).select("doc_id", "u.unit", "u.a", F.size("u.a").alias("na"))
    # A size is a key of few values, and a template one of many units, so both joins are either broadcast or salted.
    if known.agg(F.sum(F.aggregate("b", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24) + 48 * F.col("nb"))).first()[0] <= MAX_BROADCAST:
        met = units.join(F.broadcast(span), "na").join(F.broadcast(known), "template")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = units.withColumn("salt", F.pmod(F.xxhash64("doc_id", "unit"), F.lit(SALTS)).cast("int")).join(span.withColumn("salt", every), ["na", "salt"]).join(known.withColumn("salt", every), ["template", "salt"])
    met = met.withColumn("dice", F.lit(2.0) * F.size(F.array_intersect("a", "b")) / (F.col("na") + F.col("nb"))).where(F.col("dice") >= threshold)
    best = F.max(F.struct("dice", (-F.col("template")).alias("order"), "license")).alias("x")
    return met.groupBy("doc_id", "unit").agg(best).select("doc_id", "unit", "x.license", (-F.col("x.order")).alias("template"), "x.dice")


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per doc_id: doc_id, licenses (sorted distinct identifiers), n_units (units that met a template), best (highest
    coefficient, null without any).

    Null and empty texts have no licence. Rows that share a doc_id (or a null one) are scanned together. Words are runs of
    letters and digits, lower-cased; a unit of one word has no bigram. Extra columns are ignored; an empty table gives an
    empty result.
    """
    hits = licence_hits(docs, known, threshold)
    found = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.count("*").alias("n_units"), F.round(F.max("dice"), 9).alias("best"))
    found = found.withColumnsRenamed({"doc_id": "_id"})
    ids = docs.select("doc_id").distinct()
    out = ids.join(found, ids["doc_id"].eqNullSafe(found["_id"]), "left").drop("_id")
    return out.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "best")


def _oracle() -> str:
    quoted = ", ".join(f"({k}, '{x}', '{t.replace(chr(39), chr(39) * 2)}')" for k, (x, t) in enumerate(TEMPLATES))
    grams = "CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE [] END"
    return rf"""
WITH t AS (SELECT k, license, {grams} AS b FROM (SELECT k, license, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM (VALUES {quoted}) v(k, license, x))),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'), [coalesce(text, '')])) AS unit FROM documents),
g AS (SELECT doc_id, unit, {grams} AS a FROM (SELECT doc_id, unit, regexp_extract_all(lower(unit), '[\p{{L}}\p{{N}}]+') AS w FROM u)),
m AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice, row_number() OVER (PARTITION BY doc_id, unit ORDER BY 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) DESC, k) AS r FROM g JOIN t ON len(a) > 0 AND len(a) <= 3 * len(b) AND len(b) <= 3 * len(a)),
h AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS licenses, count(*) AS n_units, round(max(dice), 9) AS best FROM m WHERE r = 1 AND dice >= {THRESHOLD} GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, []) AS licenses, coalesce(n_units, 0) AS n_units, best FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN h USING (doc_id)
"""


ORACLE = _oracle()
