"""Licence scans with DataFrame and SQL functions only: TF-IDF cosine to templates, then inheritance along paths.

A unit of a text is a line or, if it has several lines, a paragraph (lines between blank ones). A unit's vector has 1 * idf for each of its
distinct words (runs of a-z and 0-9 of lower-cased text). idf(t) = ln((1 + N) / (1 + df)) + 1 over all N units with words of all documents,
for every word: document frequencies are one grouped pass. A unit whose cosine to a template is at least ``SIMILAR`` is a licence
unit. Templates are notices (compared with lines only), titles, headers and the paragraphs of whole licences. Units without any of a few telling words can't reach
``SIMILAR`` (by Cauchy-Schwarz: what their other words could give is too little); they are dropped before weights are joined.

A document's own licence is that of its best unit (ties: first template). A document is a licence file if at least half of its words are on
licence lines or in licence paragraphs, or if its first unit is a licence's title: it holds for its directory and all below, the nearest
directory first. Directories are resolved once each and joined to documents with hot directories split.

Defined cases: null or empty text has no licence unit; a null path is a directory of its own: nothing is inherited from there and its documents
inherit nothing; of equally similar licence files of a directory the first licence by name holds; repeated documents each get their own
row; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, null_as_empty, salted_join

SIMILAR, FILE_SHARE = 0.6, 0.5
#: Notices, titles, headers and paragraphs by which works commonly name or state their licence.
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "notice", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "notice", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "notice", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "notice", "Released under the MIT License"),
    ("MPL-2.0", "notice", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("Apache-2.0", "title", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "title", "BSD 3-Clause License"),
    ("CC-BY-4.0", "title", "Creative Commons Attribution 4.0 International Public License"),
    ("CC0-1.0", "title", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("GPL-3.0", "title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "title", "MIT License"),
    ("MPL-2.0", "title", "Mozilla Public License Version 2.0"),
    ("Apache-2.0", "text", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "text", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "text", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "text", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "text", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("GPL-3.0", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "text", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("LGPL-3.0", "text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MIT", "text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "text", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def terms(template: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", template.lower())))


VOCABULARY = sorted({t for _, _, x in TEMPLATES for t in terms(x)})


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def _units(text: Column) -> Column:
    """Lines and paragraphs of several lines that have words: distinct words, number of words, whether a paragraph, whether the first."""
    body = F.regexp_replace(F.lower(text), r"^[^a-z0-9]+", "")
    marked = lambda parts, paragraph: F.transform(parts, lambda x, i: F.struct(x.alias("text"), F.lit(paragraph).alias("paragraph"), (i == 0).alias("first")))
    several = F.filter(marked(F.split(body, r"\n[ \t\r]*\n"), True), lambda x: F.instr(x["text"], "\n") > 0)
    # each unit is split once
    split = F.transform(F.concat(marked(F.split(body, "\n"), False), several), lambda x: F.struct(_words(x["text"]).alias("all"), x["paragraph"].alias("paragraph"), x["first"].alias("first")))
    units = F.filter(split, lambda x: F.size(x["all"]) > 0)
    return F.transform(units, lambda x: F.struct(F.array_distinct(x["all"]).alias("words"), F.size(x["all"]).alias("n"), x["paragraph"].alias("paragraph"), x["first"].alias("first")))


def frequencies(docs: DataFrame) -> DataFrame:
    """In how many units with words each word (``term``) is, over all documents; the empty word counts units."""
    units = docs.select(F.explode(_units(F.col("text"))).alias("x"))
    each = units.select(F.explode(F.concat("x.words", F.array(F.lit("")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def telling(square: dict[str, float]) -> list[str]:
    """Words of which a unit must have one to reach ``SIMILAR`` with any template.

    A unit that shares only the words C with a template has a cosine of at most sqrt(sum of C's squares / the template's norm).
    The most common words are left out as long as that stays under ``SIMILAR`` for every template.
    """
    own = [set(terms(x)) for _, _, x in TEMPLATES]
    norm = [sum(square[t] for t in x) for x in own]
    out, left = set(VOCABULARY), [0.0] * len(own)
    for t in sorted(VOCABULARY, key=lambda t: (square[t], t)):
        more = [v + square[t] * (t in x) for v, x in zip(left, own)]
        if all(v < (SIMILAR - 1e-3) ** 2 * m for v, m in zip(more, norm)):
            out.discard(t)
            left = more
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """Own licence of each document (``path``, ``text``): adds ``own_license``, ``similarity`` and ``is_file``; ``text`` goes."""
    counts = materialise(frequencies(docs), "terms")
    few = {r["term"]: r["n"] for r in counts.filter(F.col("term").isin("", *VOCABULARY)).collect()}  # a row a template word
    n = few.get("", 0)
    square = {t: (math.log((1 + n) / (1 + few.get(t, 0))) + 1) ** 2 for t in VOCABULARY}
    weight = F.create_map(*(F.lit(x) for t in VOCABULARY for x in (t, square[t])))
    total = lambda words: F.aggregate(words, F.lit(0.0), lambda s, w: s + F.element_at(weight, w))

    def cosines(own, mass):
        """Cosine to each template of a unit with these template words and this sum of squares."""
        for k, (name, kind, text) in enumerate(TEMPLATES):
            dot = total(F.array_intersect(own, F.array(*(F.lit(t) for t in terms(text)))))
            similarity = F.round(dot / F.sqrt(mass * sum(square[t] for t in terms(text))), 6)
            if kind == "notice":  # a line, not a paragraph that has such a line
                similarity = F.when(F.col("paragraph"), 0.0).otherwise(similarity)
            yield F.struct(similarity.alias("similarity"), F.lit(-k).alias("order"), F.lit(name).alias("name"), F.lit(kind).alias("kind"))

    able = F.filter("units", lambda x: F.arrays_overlap(x["words"], F.array(*(F.lit(t) for t in telling(square)))))
    keep = [c for c in docs.columns if c != "text"]
    read = docs.withColumn("units", _units(F.col("text"))).withColumn("words", F.aggregate("units", F.lit(0), lambda s, x: s + F.when(x["paragraph"], 0).otherwise(x["n"])))
    read = materialise(read.select(*keep, F.monotonically_increasing_id().alias("row"), "words", able.alias("able")), "units")  # rows keep their numbers
    units = read.select("row", F.posexplode("able").alias("unit", "x"))
    known = F.array(*(F.lit(t) for t in VOCABULARY))
    units = units.select("row", "unit", "x.n", "x.paragraph", "x.first", F.array_intersect("x.words", known).alias("known"), F.array_except("x.words", known).alias("unknown"))
    idf = counts.select("term", F.pow(F.log((1 + n) / (1 + F.col("n"))) + 1, 2).alias("w"))
    # in one order, so that sums are the same in every run
    other = salted_join(units.select("row", "unit", F.explode("unknown").alias("term")), idf, "term").groupBy("row", "unit").agg(F.aggregate(F.sort_array(F.collect_list("w")), F.lit(0.0), lambda s, w: s + w).alias("other"))
    units = units.join(other, ["row", "unit"], "left").withColumn("mass", total(F.col("known")) + F.coalesce("other", F.lit(0.0)))
    best = units.select("row", "n", "paragraph", "first", F.array_max(F.array(*cosines(F.col("known"), F.col("mass")))).alias("best")).filter(F.col("best.similarity") >= SIMILAR)
    on = lambda paragraph: F.coalesce(F.sum(F.when(F.col("paragraph") == paragraph, F.col("n"))), F.lit(0))
    hits = best.groupBy("row").agg(F.max("best").alias("top"), F.greatest(on(False), on(True)).alias("share"), F.max(F.col("first") & (F.col("best.kind") == "title")).alias("titled"))
    is_file = F.coalesce((F.col("share") >= FILE_SHARE * F.col("words")) | F.col("titled"), F.lit(False))
    return read.drop("able").join(hits, "row", "left").select(*keep, F.col("top.name").alias("own_license"), F.col("top.similarity").alias("similarity"), is_file.alias("is_file"))


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def inherit(scanned: DataFrame) -> DataFrame:
    """Each document's licence: its own, else that of the nearest directory above it which has a licence file."""
    own = F.when(F.col("path").isNull(), F.lit("\0")).otherwise(_parent(F.col("path")))
    placed = materialise(scanned.withColumn("directory", own), "licenses")
    declared = placed.filter("is_file AND path IS NOT NULL").groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("unlike"), "own_license")).alias("best"))
    declared = declared.select(F.col("directory").alias("above"), F.col("best.own_license").alias("inherited"))
    parts = F.split("directory", "/")
    # the root, then each directory down to the own one; what has no path has none above it
    chain = F.when(F.col("directory") == "\0", F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    directories = placed.select("directory").distinct().withColumn("above", F.explode_outer(F.array_distinct(chain)))
    nearest = directories.join(declared, "above", "left").groupBy("directory").agg(F.max(F.when(F.col("inherited").isNotNull(), F.struct(F.length("above").alias("depth"), "above", "inherited"))).alias("best"))
    nearest = nearest.select("directory", F.col("best.inherited").alias("inherited"), F.col("best.above").alias("inherited_from"))
    out = salted_join(placed, nearest, "directory")
    return out.withColumn("license", F.coalesce("own_license", "inherited")).withColumn("license_from", F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("inherited_from"))).drop("inherited", "inherited_from", "directory")


def report(docs: DataFrame, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), path.alias("path"), null_as_empty(text).alias("text"))
    return inherit(scan(rows)).select("doc_id", "path", "own_license", "similarity", "is_file", "license", "license_from")


def oracle(path_sql: str) -> str:
    """The same in DuckDB's SQL."""
    own = ["[" + ", ".join(f"'{t}'" for t in terms(x)) + "]" for _, _, x in TEMPLATES]
    names = ", ".join(f"({k}, '{name}', '{kind}', {own[k]})" for k, (name, kind, _) in enumerate(TEMPLATES))
    words = "list_filter(regexp_split_to_array(l, '[^a-z0-9]+'), lambda w: w <> '')"
    gap = "chr(10) || '[ ' || chr(9) || chr(13) || ']*' || chr(10)"
    return f"""
WITH docs AS (SELECT doc_id, {path_sql} AS path, regexp_replace(lower(coalesce(text, '')), '^[^a-z0-9]+', '') AS body FROM documents),
parts AS (SELECT doc_id, false AS paragraph, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) = 1 AS first FROM docs
 UNION ALL SELECT doc_id, true, unnest(regexp_split_to_array(body, {gap})), generate_subscripts(regexp_split_to_array(body, {gap}), 1) = 1 FROM docs),
lines AS (SELECT row_number() OVER () AS line_id, doc_id, paragraph, first, len({words}) AS n, list_distinct({words}) AS words FROM parts WHERE (NOT paragraph OR contains(l, chr(10))) AND len({words}) > 0),
size AS (SELECT count(*) AS n FROM lines),
token AS (SELECT line_id, unnest(words) AS t FROM lines),
df AS (SELECT t, count(*) AS df FROM token GROUP BY t),
template AS (SELECT * FROM (VALUES {names}) v(k, name, kind, own)),
tt AS (SELECT k, name, kind, unnest(own) AS t FROM template),
idf AS (SELECT t, power(ln((1 + n) / (1 + coalesce(df, 0))) + 1, 2) AS w FROM (SELECT t FROM df UNION SELECT t FROM tt) LEFT JOIN df USING (t), size),
mass AS (SELECT line_id, sum(w) AS mass FROM token JOIN idf USING (t) GROUP BY line_id),
tn AS (SELECT k, sum(w) AS norm FROM tt JOIN idf USING (t) GROUP BY k),
dots AS (SELECT line_id, k, name, kind, sum(w) AS dot FROM token JOIN tt USING (t) JOIN idf USING (t) JOIN lines USING (line_id) WHERE NOT (paragraph AND kind = 'notice') GROUP BY ALL),
cos AS (SELECT line_id, k, name, kind, round(dot / sqrt(mass * norm), 6) AS similarity FROM dots JOIN mass USING (line_id) JOIN tn USING (k)),
hits AS (SELECT line_id, max(similarity) AS similarity, arg_max(name, (similarity, -k)) AS name, arg_max(kind, (similarity, -k)) AS kind, arg_max(-k, (similarity, -k)) AS o FROM cos GROUP BY ALL HAVING max(similarity) >= {SIMILAR}),
own AS (SELECT doc_id, arg_max(name, (similarity, o)) AS own_license, max(similarity) AS similarity, greatest(coalesce(sum(n) FILTER (NOT paragraph), 0), coalesce(sum(n) FILTER (paragraph), 0)) AS hit, max(first AND kind = 'title') AS titled FROM hits JOIN lines USING (line_id) GROUP BY doc_id),
words AS (SELECT doc_id, sum(n) AS n FROM lines WHERE NOT paragraph GROUP BY doc_id),
scanned AS (SELECT doc_id, path, own_license, similarity, coalesce(hit >= {FILE_SHARE} * n OR titled, false) AS is_file, regexp_replace(path, '/[^/]*$', '') AS directory
  FROM docs LEFT JOIN own USING (doc_id) LEFT JOIN words USING (doc_id)),
declared AS (SELECT directory AS above, arg_min(own_license, (-similarity, own_license)) AS inherited FROM scanned WHERE is_file GROUP BY 1),
nearest AS (SELECT directory, arg_max(inherited, length(above)) AS inherited, arg_max(above, length(above)) AS inherited_from
  FROM (SELECT DISTINCT directory FROM scanned) JOIN declared ON directory = above OR starts_with(directory, above || '/') GROUP BY 1)
SELECT doc_id, path, own_license, similarity, is_file, coalesce(own_license, inherited) AS license, CASE WHEN own_license IS NULL THEN inherited_from ELSE path END AS license_from
FROM scanned LEFT JOIN nearest USING (directory)"""
