"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts are lower-cased with every run of other than letters and digits as one
space. Compared with each template are: each line; the whole text where it has
several; and, across line breaks and within lines, the window of as many words
as the template from every bigram on that the template has (to the end of the
text, if that is nearer). Moved right to its first such bigram a window loses
none of them, so no window of that size anywhere scores more. The score is twice
the number of bigrams in common (as often as both have them) over the sum of
both numbers. Templates whose size rules out the threshold for a line, text or
window are pruned before it is scored. DataFrame operations only: bigrams are
built and looked up in one pass over the texts, and only those that some
template has leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paymatch.llm.store import drop, save

THRESHOLD = 0.8

#: Common licence notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd-2-clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
     "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
     "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
     "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
     "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
     "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License."),
    ("bsd-header", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
     "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
     "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
     "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
     "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " "), "")


def _bigrams(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per bigram of ``words``; ``keep`` may use its place ``at``."""
    at = F.explode(F.sequence(F.lit(0), F.size("words") - 2))
    return rows.where(F.size("words") >= 2).select("*", at.alias("at")).select(
        *keep, F.xxhash64(F.get("words", F.col("at")), F.get("words", F.col("at") + 1)).alias("bigram"))


def _parts(hits: DataFrame, line: Column, n: Column, threshold: float) -> DataFrame:
    """The best template of each part (a line, or the whole text) of ``n`` bigrams."""
    ratio = threshold / (2 - threshold)
    fits = (F.col("size") >= F.col("n") * ratio) & (F.col("n") >= F.col("size") * ratio)
    common = (hits.select("doc_id", "text_hash", line.alias("line"), "license", n.alias("n"), "size", "has", "bigram").where(fits)
              .groupBy("doc_id", "text_hash", "line", "license", "n", "size", "has", "bigram").agg(F.count("*").alias("times"))
              .groupBy("doc_id", "text_hash", "line", "license", "n", "size").agg(F.sum(F.least("times", "has")).alias("both")))
    dice = common.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "text_hash", "line").agg(
        F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    return best.select("doc_id", "text_hash", "line", F.col("best.license").alias("license"),
                       (-F.col("best.less")).alias("dice"))


def _windows(hits: DataFrame, threshold: float) -> DataFrame:
    """Windows over the whole text that no better one of the same template overlaps (ties: the earlier is better).

    A bigram counts in a window if fewer than ``has`` of its kind come before
    it there, so each hit carries the place of the ``has``-th one before it,
    and a window is scored by one pass over its own hits.
    """
    one = ("doc_id", "text_hash", "license", "size", "n")
    seen = hits.groupBy(*one, "has", "bigram").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("same"))
    marked = seen.select(*one, F.explode(F.transform("same", lambda x, k: F.struct(
        x["at"].alias("at"), x["line"].alias("line"),
        F.coalesce(F.get("same", k - F.col("has").cast("int"))["at"], F.lit(-1)).alias("before")))).alias("hit"))
    size = F.col("size")
    ordered = marked.groupBy(*one).agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    def least(span: Column) -> Column:
        return F.ceil(threshold * (span + size) / 2 - 1e-6).cast("int")

    # a window has as many hits as it needs, or is not scored
    starts = F.filter(
        F.transform("hits", lambda x, i: F.struct(x["at"].alias("at"), x["line"].alias("line"), i.alias("i"),
                                                  F.least(size, F.col("n") - x["at"]).alias("span"))),
        lambda y: F.get("hits", y["i"] + least(y["span"]) - 1)["at"] < y["at"] + size)
    scored = F.transform(starts, lambda y: F.struct(
        y["at"].alias("at"), y["line"].alias("line"),
        (2.0 * F.size(F.filter(F.slice("hits", y["i"] + 1, size),
                               lambda z: (z["at"] < y["at"] + size) & (z["before"] < y["at"])))
         / (y["span"] + size)).alias("dice")))
    fitting = ordered.select(*one, F.filter(scored, lambda y: y["dice"] >= threshold).alias("fit")).where(F.size("fit") > 0)

    def beaten(x: Column, i: Column) -> Column:
        near = F.slice("fit", F.greatest(i + 1 - size, F.lit(1)), 2 * size)
        return F.exists(near, lambda z: (F.abs(z["at"] - x["at"]) < size) & (
            (z["dice"] > x["dice"]) | ((z["dice"] == x["dice"]) & (z["at"] < x["at"]))))

    kept = F.explode(F.filter("fit", lambda x, i: ~beaten(x, i)))
    return fitting.select("doc_id", "text_hash", "license", kept.alias("w")).select(
        "doc_id", "text_hash", F.col("w.line").alias("line"), "license", F.col("w.dice").alias("dice"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices in documents.

    Returns one row per document, line and licence: doc_id, text_hash, line,
    license, dice (the best there). A line, and the whole text (line -1), names
    the best template that fits it (ties to the first by name); a window names
    its template on the line where it begins. Templates need two words; the
    list is broadcast, so it should be a list of notices, not a corpus. Null
    texts hold nothing; documents that repeat both id and text are one.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame(list(templates), "license string, notice string").select(
        "license", _words(F.col("notice")).alias("words")).where(F.size("words") >= 2)
    wanted = (_bigrams(known, "license", (F.size("words") - 1).alias("size"))
              .groupBy("license", "size", "bigram").agg(F.count("*").alias("has")))
    text = F.col("text").cast("string")
    by_line = (docs.where(text.isNotNull())
               .select("doc_id", F.xxhash64(text).alias("text_hash"), F.transform(F.split(text, "\n"), _words).alias("by_line")))
    flat = by_line.select(
        "doc_id", "text_hash", F.flatten("by_line").alias("words"), F.size("by_line").alias("lines"),
        F.transform("by_line", F.size).alias("in_line"),
        F.flatten(F.transform("by_line", lambda x, i: F.array_repeat(i, F.size(x)))).alias("line_of"))
    line = F.get("line_of", F.col("at"))
    found = _bigrams(flat, "doc_id", "text_hash", "lines", (F.size("words") - 1).alias("n"), "at", line.alias("line"),
                     (F.get("in_line", line) - 1).alias("line_n"), (F.get("line_of", F.col("at") + 1) == line).alias("inside"))
    # no line, text or window of a text that is too short can fit
    ratio = threshold / (2 - threshold)
    hits = save(found.join(F.broadcast(wanted), "bigram").where(F.col("n") >= F.col("size") * ratio).distinct(), "licenses")
    rows = (_parts(hits.where("inside"), F.col("line"), F.col("line_n"), threshold)
            .unionByName(_parts(hits.where("lines > 1"), F.lit(-1), F.col("n"), threshold))
            .unionByName(_windows(hits, threshold)))
    best = save(rows.groupBy("doc_id", "text_hash", "line", "license").agg(F.max("dice").alias("dice")), "notices")
    drop(hits)
    return best


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The result over ``documents`` in DuckDB SQL, without pruning."""
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates)
    words = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH notices(license, notice) AS (VALUES {rows}),
known AS (SELECT license, {words.format('notice')} AS w FROM notices),
wanted AS (
  SELECT license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS has
  FROM (SELECT license, w, unnest(range(1, len(w))) AS i FROM known) GROUP BY ALL
), split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS line FROM split
  UNION ALL SELECT doc_id, text, -1 FROM split WHERE len(l) > 1
), sized AS (SELECT doc_id, line, {words.format('part')} AS w FROM parts),
bigrams AS (
  SELECT doc_id, line, len(w) - 1 AS n, w[i] || ' ' || w[i + 1] AS bigram, count(*) AS times
  FROM (SELECT doc_id, line, w, unnest(range(1, len(w))) AS i FROM sized WHERE len(w) >= 2) GROUP BY ALL
), dice AS (
  SELECT doc_id, line, license, CAST(2 * sum(least(times, has)) AS DOUBLE) / (n + size) AS dice
  FROM bigrams JOIN wanted USING (bigram) GROUP BY doc_id, line, license, n, size
), whole AS (
  SELECT doc_id, line, license, dice FROM dice WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) = 1
), spread AS (
  SELECT doc_id, line, w[i] AS word, i FROM (SELECT doc_id, line, w, unnest(range(1, len(w) + 1)) AS i FROM sized WHERE line >= 0)
  WHERE w[i] <> ''
), running AS (
  SELECT doc_id, line, row_number() OVER d - 1 AS pos, word || ' ' || lead(word) OVER d AS bigram,
         count(*) OVER (PARTITION BY doc_id) - 1 AS n
  FROM spread WINDOW d AS (PARTITION BY doc_id ORDER BY line, i)
), hits AS (
  SELECT doc_id, line, pos, n, license, size, has, r.bigram FROM running r JOIN wanted USING (bigram)
), inner_bigrams AS (
  SELECT s.doc_id, s.license, s.line, s.pos, s.size, least(s.size, s.n - s.pos) AS span, h.bigram, least(count(*), h.has) AS shared
  FROM hits s JOIN hits h ON h.doc_id = s.doc_id AND h.license = s.license AND h.pos >= s.pos AND h.pos < s.pos + s.size
  GROUP BY s.doc_id, s.license, s.line, s.pos, s.size, s.n, h.bigram, h.has
), windows AS (
  SELECT doc_id, license, line, pos, size, CAST(2 * sum(shared) AS DOUBLE) / (span + size) AS dice FROM inner_bigrams
  GROUP BY doc_id, license, line, pos, size, span HAVING CAST(2 * sum(shared) AS DOUBLE) / (span + size) >= {threshold}
), best AS (
  SELECT doc_id, line, license, dice FROM windows w WHERE NOT EXISTS (
    SELECT 1 FROM windows o WHERE o.doc_id = w.doc_id AND o.license = w.license AND abs(o.pos - w.pos) < w.size
      AND (o.dice > w.dice OR (o.dice = w.dice AND o.pos < w.pos)))
)
SELECT doc_id, CAST(line AS INTEGER) AS line, license, max(dice) AS dice
FROM (SELECT * FROM whole UNION ALL SELECT * FROM best) GROUP BY doc_id, line, license
"""
