"""License scans: segments of a text against licence templates by Dice coefficient over word bigrams.

A text's segments are itself whole, its paragraphs (between blank lines), its lines, and runs of
neighbouring lines, which runs of paragraphs are too.  A run counts for a licence only where neither
the whole text nor a paragraph that it touches matches that licence: ``oracle``, which has no runs,
settles those.  Runs of one licence text overlap, so of a licence's runs in a document only the best
counts, and only if it scores above all other segments.
Runs hold at most RUN_WORDS words for each bigram that a segment may have; they are made only where
the text as a whole holds enough bigrams of a template, and start and end at lines that hold one,
as others would only lower the score.  Texts and
templates are normalised alike: lower case, and everything but a-z and 0-9 separates words.  A
segment with A distinct bigrams and a template with B, of which they share S, reach LEAST = p / q if
2 q S >= p (A + B).  As S is at most A and at most B, that needs p B / (2 q - p) <= A <= (2 q - p) B / p
and as many shared bigrams as the lower bound.  All of this is done in integers, so a segment just on a bound is kept.  So a text must hold one of any set that leaves
out fewer of a template's bigrams (``anchors``): lower-cased texts without one are dropped before they are
normalised (``sieved``), then those of many lines that as a whole share too few with every template, as their segments share
no more, and segments without an anchor.  So are segments
outside the size bounds of all templates, before anything is joined, and bigrams only meet
templates whose bounds hold.  All of it is DataFrame functions.  Templates are a parameter; what they
hold, at most MOST_BIGRAMS bigrams, is a constant table, so broadcasting it is bounded.

A text of one word has that word as its only bigram; null, empty and wordless texts match nothing.
Every row of the table gives a row; rows that share an id share their result (that of all their
texts), rows without an id have that of their own text.  An empty table gives no rows; other columns are not read.
Equal scores go to the smaller licence id.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

LEAST = 0.8
MOST_BIGRAMS = 50_000
#: Words of a run for each distinct bigram that it may have: more repeat what it has.
RUN_WORDS = 2
#: What parts the paragraphs of a normalised text.
PARAGRAPHS = "\\n *\\n[ \\n]*"

_MIT_TERMS = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (licence id, text): public licence texts, the notices that their publishers ask for, and short forms of them.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", f"{_MIT_TERMS} {_MIT_DISCLAIMER}"),
    ("MIT", _MIT_TERMS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", f"{_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_TERMS} {_BSD_THIRD} {_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]


def _ratio(least: float) -> tuple[int, int]:
    """p and q of the least score p / q, as it is written in decimals."""
    return Fraction(str(least)).as_integer_ratio()


def _bounds(bigrams: int, least: float) -> tuple[int, int]:
    """The fewest and most bigrams of a segment that may match a template of so many; it shares the fewest at least."""
    p, q = _ratio(least)
    return -(-p * bigrams // (2 * q - p)), (2 * q - p) * bigrams // p


def _normal(lower: Column) -> Column:
    """Words of a lower-cased text parted by spaces; line feeds stay, for lines and paragraphs."""
    return F.regexp_replace(lower, "[^a-z0-9\\n]+", " ")


def _bigrams(segment: Column) -> Column:
    """Distinct bigrams; of one word, that word; of none, an empty array."""
    words = F.array_remove(F.split(F.translate(segment, "\n", " "), " "), "")
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), after, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], least: float) -> list[tuple[int, str, list[str]]]:
    """(number, licence, bigrams) of each template, which must have a bigram and all together few."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    out = [tuple(r) for r in rows.select("template", "license", _bigrams(_normal(F.lower("text"))).alias("bigrams")).orderBy("template").collect()]
    if not out or not all(b for *_, b in out) or sum(len(b) for *_, b in out) > MOST_BIGRAMS:
        raise ValueError(f"templates need words, and at most {MOST_BIGRAMS} bigrams in all")
    return out


def anchors(held: list[tuple[int, str, list[str]]], least: float) -> list[str]:
    """Bigrams, those with long words first, such that nothing reaches ``least`` with a template and has none of them:
    fewer of the template's bigrams are left out than must be shared."""
    chosen: set[str] = set()
    for *_, bigrams in held:
        need = len(bigrams) - _bounds(len(bigrams), least)[0] + 1
        chosen.update(sorted(bigrams, key=lambda b: (b not in chosen, -max(map(len, b.split())), -len(b), b))[:need])
    return sorted(chosen)


def _once(value: Column) -> Column:
    """As a generator's output a value is computed once, however many filters and columns above read it."""
    return F.explode(F.array(value))


def sieved(lower: DataFrame, named: list[str]) -> DataFrame:
    """The rows whose ``lower``, a lower-cased text, has one of these bigrams, whatever parts its words.

    The longer word is searched first, as plain bytes, and only where it is found the bigrams that it is in,
    by patterns that begin with a word, as those skip most of a text."""
    gates: dict[str, dict[str, list[str]]] = {}
    for bigram in named:
        first, *second = bigram.split()
        gates.setdefault(max([first, *second], key=len), {}).setdefault(first, []).append("".join(f"[^a-z0-9]+{w}" for w in second))
    found = []
    for gate, firsts in sorted(gates.items(), key=lambda x: (-len(x[0]), x[0])):
        ways = [F.contains("lower", F.lit(w)) & F.col("lower").rlike(f"{w}(?<![a-z0-9]{w})(?:{'|'.join(after)})(?![a-z0-9])") for w, after in firsts.items()]
        found.append(F.contains("lower", F.lit(gate)) & reduce(or_, ways))
    return lower.where(reduce(or_, found))


def _segment_hash(bigrams: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", bigrams))


def _segments(normal: DataFrame, held: list[tuple[int, str, list[str]]], least: float) -> DataFrame:
    """(key, segment, touched) of each normalised text; ``touched`` has the hashes of the whole text
    and the paragraphs that a run touches, and is null for other segments."""
    every = sorted({b for *_, bigrams in held for b in bigrams})
    known = F.when(F.instr("normal", "\n") > 0, F.array_intersect(_bigrams(F.col("normal")), F.lit(every)))
    # the most words of a run, by the templates whose bigrams the text holds enough of
    most = F.greatest(F.lit(0), *[F.when(F.size(F.array_intersect("known", F.lit(b))) >= _bounds(len(b), least)[0], RUN_WORDS * _bounds(len(b), least)[1] + 1) for *_, b in held])
    texts = normal.select("key", "normal", _once(known).alias("known")).select("key", "normal", _once(most).alias("most"))
    if all(" " in b for b in every):  # a line of one word has that word as its bigram, which the whole text has not
        texts = texts.where((F.col("most") > 0) | (F.instr("normal", "\n") == 0))

    def lines_of(paragraph: Column) -> Column:
        kept = F.filter(F.transform(F.split(paragraph["text"], "\n"), lambda x: F.trim(x)), lambda x: x != "")
        return F.transform(kept, lambda x: F.struct(x.alias("line"), F.size(F.split(x, " +")).alias("words"), paragraph["hash"].alias("paragraph")))

    lines = F.when(F.col("most") > 0, F.flatten(F.transform(F.transform(F.split("normal", PARAGRAPHS), lambda p: F.struct(p.alias("text"), _segment_hash(_bigrams(p)).alias("hash"))), lines_of)))
    texts = texts.select("key", "normal", "most", F.when(F.col("most") > 0, _segment_hash(_bigrams(F.col("normal")))).alias("whole"), _once(lines).alias("lines"))

    def holds(two: Column) -> Column:
        return F.exists(_bigrams(F.array_join(two["line"], " ")), lambda b: b.isin(every))

    simple = F.array_distinct(F.concat(F.array("normal"), F.split("normal", PARAGRAPHS), F.split("normal", "\n")))
    none = F.filter("lines", lambda x: F.lit(False))
    starts = F.filter(F.sequence(F.lit(1), F.size("lines") - 1), lambda i: holds(F.slice("lines", i, 2)))
    starts = F.when(F.size("lines") > 1, F.transform(starts, lambda i: F.struct(F.lit(None).cast("string").alias("segment"), F.slice("lines", i, F.col("most")).alias("lines"))))
    parts = F.concat(F.transform(simple, lambda x: F.struct(x.alias("segment"), none.alias("lines"))), F.coalesce(starts, F.array()))
    texts = texts.select("key", "most", "whole", F.explode(parts).alias("part")).select("key", "most", "whole", "part.*")
    fitting = F.aggregate("lines", F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")), lambda got, x: F.struct(
        (got["words"] + x["words"]).alias("words"), (got["lines"] + F.when(got["words"] + x["words"] <= F.col("most"), 1).otherwise(0)).alias("lines")))["lines"]
    texts = texts.select("key", "segment", "whole", "lines", _once(F.when(F.col("segment").isNull(), fitting)).alias("fitting")).where("segment is not null or fitting > 1")
    ends = F.filter(F.sequence(F.lit(2), "fitting"), lambda n: holds(F.slice("lines", n - 1, 2)))
    runs = F.transform(ends, lambda n: F.struct(F.array_join(F.slice("lines", 1, n)["line"], "\n").alias("segment"), F.array_distinct(F.concat(F.array("whole"), F.slice("lines", 1, n)["paragraph"])).alias("touched")))
    alone = F.array(F.struct("segment", F.lit(None).cast("array<long>").alias("touched")))
    return texts.select("key", F.explode(F.when(F.col("segment").isNotNull(), alone).otherwise(runs)).alias("part")).select("key", "part.*")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, license, dice, licenses, n_matches.

    ``license`` and ``dice`` are of the best segment and template, ``licenses`` all licences found in
    order, ``n_matches`` the distinct segments that some template matched; without any: null, null, "" and 0.
    """
    spark = docs.sparkSession
    held = template_table(spark, templates or TEMPLATES, least)
    # rows without an id are known by their texts: they are not one group, and copies share a result
    key = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.concat(F.lit("t"), F.md5(F.col(text_col).cast("binary"))))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    (p, q), sizes = _ratio(least), [_bounds(len(b), least) for *_, b in held]
    few, many = min(a for a, _ in sizes), max(b for _, b in sizes)
    named = anchors(held, least)
    lower = sieved(docs.where(F.col("text").isNotNull()).select("key", _once(F.lower("text")).alias("lower")), named)
    normal = lower.select("key", _once(_normal(F.col("lower"))).alias("normal"))
    segments = _segments(normal, held, least)
    bigrams = segments.select("key", "touched", _once(_bigrams(F.col("segment"))).alias("bigrams")).where(F.size("bigrams").between(few, many))
    bigrams = bigrams.where(F.exists("bigrams", lambda b: b.isin(named))).withColumn("segment", F.concat_ws("\n", "bigrams"))
    single = bigrams.groupBy("key", "segment", "touched").agg(F.first("bigrams").alias("bigrams"))
    table_ = spark.createDataFrame([(k, name, b, len(bs)) for k, name, bs in held for b in bs], "template int, license string, bigram string, held int")
    words = single.select("key", "segment", "touched", F.size("bigrams").alias("size"), F.explode("bigrams").alias("bigram"))
    fits = 2 * q * F.least("size", "held") >= p * (F.col("size") + F.col("held"))
    shared = words.join(F.broadcast(table_), "bigram").where(fits).groupBy("key", "segment", "touched", "size", "template", "license", "held").agg(F.count("*").alias("shared"))
    dice = shared.where(2 * q * F.col("shared") >= p * (F.col("size") + F.col("held"))).withColumn("dice", 2.0 * F.col("shared") / (F.col("size") + F.col("held")))
    alike = Window.partitionBy("key", "license")
    simple, order = F.col("touched").isNull(), F.struct(-F.col("dice"), "size", "segment")
    dice = dice.withColumn("others", F.max(F.when(simple, F.col("dice"))).over(alike)).withColumn("settled", F.collect_set(F.when(simple, F.xxhash64("segment"))).over(alike))
    dice = dice.where(simple | (~F.arrays_overlap("touched", "settled") & (F.col("dice") > F.coalesce("others", F.lit(0.0)))))
    dice = dice.withColumn("best_run", F.min(F.when(~simple, order)).over(alike)).where(simple | (order == F.col("best_run")))
    best = dice.groupBy("key").agg(F.min(F.struct(-F.col("dice"), "license")).alias("best"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.countDistinct("segment").alias("n_matches"))
    best = best.select("key", F.col("best.license").alias("license"), (-F.col("best.col1")).alias("dice"), "licenses", "n_matches")
    out = docs.select("doc_id", "key").join(best, "key", "left")
    return out.select("doc_id", "license", "dice", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"))


def oracle(templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> str:
    """DuckDB SQL for ``scan`` over ``documents``: every segment against every template, without size bounds."""
    p, q = _ratio(least)
    values = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(templates or TEMPLATES))
    words = "list_filter(string_split(replace({}, chr(10), ' '), ' '), lambda x: x <> '')"
    bigrams = "CASE WHEN len(w) = 1 THEN w WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END"
    return f"""
    WITH normal AS (SELECT doc_id, CASE WHEN doc_id IS NULL THEN text END AS own, regexp_replace(lower(text), '[^a-z0-9' || chr(10) || ']+', ' ', 'g') AS n FROM documents),
    segments AS (SELECT doc_id, own, unnest(list_distinct([n] || string_split_regex(n, '\\n *\\n[ \\n]*') || string_split(n, chr(10)))) AS s FROM normal),
    sets AS (SELECT DISTINCT doc_id, own, list_sort({bigrams}) AS g FROM (SELECT doc_id, own, {words.format('s')} AS w FROM segments)),
    templates AS (SELECT k, license, {bigrams} AS g FROM (SELECT k, license, {words.format("regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')")} AS w FROM (VALUES {values}) v(k, license, t))),
    pairs AS (SELECT doc_id, own, license, sets.g AS g, len(list_intersect(sets.g, templates.g)) AS shared, len(sets.g) + len(templates.g) AS held FROM sets, templates),
    found AS (SELECT *, 2.0::DOUBLE * shared / held AS dice FROM pairs WHERE shared > 0 AND {2 * q} * shared >= {p} * held),
    best AS (SELECT doc_id, own, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT g) AS n_matches FROM found GROUP BY doc_id, own)
    SELECT d.doc_id, b.license, b.dice, coalesce(b.licenses, '') AS licenses, coalesce(b.n_matches, 0) AS n_matches
    FROM documents d LEFT JOIN best b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND (d.doc_id IS NOT NULL OR d.text = b.own)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
