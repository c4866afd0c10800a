"""Licence scan by Dice coefficient over word bigrams, on DataFrame operations only.

Units of a text are its lines, its paragraphs of several lines (blank lines stand
between paragraphs) and, if it has several paragraphs, the whole text. A unit and a
template are folded to lower-case words of a-z and 0-9; their sets of word bigrams give

    dice = 2 * shared / (unit + template).

dice >= t bounds the sizes: t / (2 - t) <= unit / template <= (2 - t) / t, and a unit has
that share of the template's bigrams at least. What can't match goes early:

* A few words (`marks`) are chosen so that the other words' bigrams alone are too few for
  any template. Texts, then units, that hold none of them are dropped before they are folded.
* Units of too few words or too many distinct words for every template are dropped before
  bigrams are formed, units outside all bounds before bigrams leave the row, and pairs
  outside a template's own bounds before they are counted.

Templates are a literal table in this module (some thousand bigrams): notices, whole
licence texts and their paragraphs. It is the broadcast side up to BROADCAST bigrams; a
larger list of templates is joined by shuffle. Shared bigrams are counted map-side per
unit, so a phrase that is in a third of all texts adds no hot group.

Null, empty and wordless units match nothing; units of one word have no bigram. Null
ids are kept. Repeated rows are one document each id; of equally similar units the
first counts. Further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT = 80
BROADCAST = 100_000

# Licence notices by SPDX-like name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


_MIT_GRANT = TEMPLATES[2][1]
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

# Whole licence texts, by paragraph, without the lines that name a holder.
TEXTS = (
    ("MIT", ("MIT License", _MIT_GRANT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _WARRANTY)),
    ("BSD-2-Clause", (TEMPLATES[16][1], "1. " + _BSD_SOURCE, "2. " + _BSD_BINARY, _BSD_WARRANTY)),
    ("BSD-3-Clause", (TEMPLATES[16][1], "1. " + _BSD_SOURCE, "2. " + _BSD_BINARY, "3. " + _BSD_NAME, _BSD_WARRANTY)),
    ("ISC", (TEMPLATES[15][1], "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("Zlib", ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.", "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "3. This notice may not be removed or altered from any source distribution.")),
    ("Unlicense", (TEMPLATES[17][1], "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("Apache-2.0", (TEMPLATES[4][1], "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")),
    ("GPL-3.0", (TEMPLATES[6][1], "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.")),
)
# Words too frequent to tell a licence.
FREQUENT = frozenset("a all an and any are as at be by for from if in is it its no not of on or that the this to under with you your 0 1 2 3 4 being but copy event following free including may most must new other part shall such provided use we will without work".split())


def all_templates() -> tuple[tuple[str, str], ...]:
    """The notices, the whole texts, and their paragraphs of eight words or more; of equal ones the first."""
    out = dict.fromkeys(TEMPLATES)
    out |= dict.fromkeys((name, "\n\n".join(parts)) for name, parts in TEXTS)
    seen = {" ".join(_folded(t)) for _, t in out}
    for name, parts in TEXTS:
        for part in parts:
            key = " ".join(_folded(part))
            if key.count(" ") >= 7 and key not in seen:
                seen.add(key)
                out[name, part] = None
    return tuple(out)


def fold(text: Column) -> Column:
    """Words of a-z and 0-9, one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def _folded(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _pairs(text: str) -> set[tuple[str, str]]:
    w = _folded(text)
    return set(zip(w[:-1], w[1:], strict=True))


def marks(templates: tuple[tuple[str, str], ...], percent: int) -> list[str]:
    """Words of which every unit that matches a template has one.

    Such a unit has percent / (200 - percent) of the template's bigrams; the words are
    chosen, the most useful first (short and frequent ones last), until the bigrams without them are fewer than that.
    """
    left = []
    for _, text in templates:
        pairs = _pairs(text)
        least = -(-percent * len(pairs) // (200 - percent))
        left.append((pairs, least))
    out: list[str] = []
    while left := [(p, n) for p, n in left if len(p) >= n > 0]:
        gain: dict[str, int] = {}
        for pairs, _ in left:
            for pair in pairs:
                for word in set(pair):
                    gain[word] = gain.get(word, 0) + 1
        best = min(gain, key=lambda x: ((x in FREQUENT) + (len(x) < 5), -gain[x], x))
        out.append(best)
        left = [({pair for pair in p if best not in pair}, n) for p, n in left]
    return out


def license_scan(docs: DataFrame, percent: int = PERCENT, templates: tuple[tuple[str, str], ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, unit (kind and number of the best unit), shared, unit_bigrams and dice; the best unit of each licence."""
    templates = all_templates() if templates is None else templates
    spark, sizes = docs.sparkSession, [len(_pairs(t)) for _, t in templates]
    t = percent / 100
    least, most = min(sizes) * t / (2 - t), max(sizes) * (2 - t) / t
    rows = [(i, name, size, " ".join(_folded(text))) for i, ((name, text), size) in enumerate(zip(templates, sizes, strict=True))]
    known = spark.createDataFrame(rows, "template int, license string, template_bigrams int, folded string")
    known = known.withColumn("bigram", F.explode(_bigrams(F.split("folded", " ")))).drop("folded")
    known = F.broadcast(known) if sum(sizes) <= BROADCAST else known
    words = marks(templates, percent)

    starts = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    pattern = f"(?<![a-z0-9])(?=[{''.join(starts)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in starts.items()) + ")"

    def marked(text: Column) -> Column:
        """Whether a word begins with a mark: one pass, by first letters."""
        return F.lower(text).rlike(pattern)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull() & marked(F.col("text")))
    paragraphs = F.split("text", r"\n[ \t\r]*\n\s*")
    units = F.concat(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("no"), x.alias("unit"))),
        F.filter(F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("no"), x.alias("unit"))), lambda p: p["unit"].contains("\n")),
        F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("kind"), F.lit(0).alias("no"), F.col("text").alias("unit")))).otherwise(F.expr("array()")),
    )
    u = d.select("doc_id", F.explode(units).alias("u")).filter(marked(F.col("u.unit"))).select("doc_id", "u.kind", "u.no", F.split(fold(F.col("u.unit")), " ").alias("words"))
    # n distinct bigrams need n + 1 words, and have n + 1 distinct words at most
    u = u.filter((F.size("words") > least) & (F.size("words") > 1)).filter(F.size(F.array_distinct("words")) <= most + 1).withColumn("bigrams", _bigrams(F.col("words")))
    u = u.withColumn("unit_bigrams", F.size("bigrams")).filter((F.col("unit_bigrams") >= least) & (F.col("unit_bigrams") <= most))
    hit = u.select("doc_id", "kind", "no", "unit_bigrams", F.explode("bigrams").alias("bigram")).join(known, "bigram")
    a, b = F.col("unit_bigrams"), F.col("template_bigrams")
    hit = hit.filter((a * (200 - percent) >= b * percent) & (b * (200 - percent) >= a * percent))
    shared = hit.groupBy("doc_id", "kind", "no", "template", "license", "unit_bigrams", "template_bigrams").agg(F.count("*").alias("shared"))
    shared = shared.filter(200 * F.col("shared") >= percent * (a + b)).withColumn("dice", 2.0 * F.col("shared") / (a + b))
    # the most similar unit; then the first template, kind (line, paragraph, text) and number
    best = F.min_by(F.struct("kind", "no", "shared", "unit_bigrams", "dice"), F.struct((-F.col("dice")).alias("d"), "template", "kind", "no")).alias("best")
    return shared.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "best.kind", F.col("best.no").alias("no"), F.col("best.shared").alias("shared"), F.col("best.unit_bigrams").alias("unit_bigrams"), F.col("best.dice").alias("dice"))


def oracle(percent: int = PERCENT) -> str:
    """The same scan in DuckDB's SQL, which folds the templates itself and has no bounds."""
    known = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(all_templates()))
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(template, license, text)),
d AS (SELECT doc_id, text, row_number() OVER () AS rowid_ FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, row_id, 'line' AS kind, unnest(range(len(x))) AS no, unnest(x) AS unit
  FROM (SELECT doc_id, rowid_ AS row_id, string_split(text, chr(10)) AS x FROM d)
  UNION ALL
  SELECT * FROM (SELECT doc_id, row_id, 'paragraph' AS kind, unnest(range(len(x))) AS no, unnest(x) AS unit
    FROM (SELECT doc_id, rowid_ AS row_id, string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*') AS x FROM d)) WHERE contains(unit, chr(10))
  UNION ALL
  SELECT doc_id, rowid_, 'text', 0, text FROM d WHERE len(string_split_regex(text, '\\n[ \\t\\r]*\\n\\s*')) > 1
),
folded AS (SELECT doc_id, row_id, kind, no, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (
  SELECT doc_id, kind, no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM folded WHERE len(w) > 1
), bound AS (SELECT * FROM grams WHERE len(g) >= 1),
template_grams AS (
  SELECT template, license, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT template, license, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM known)
), exploded AS (SELECT doc_id, kind, no, len(g) AS a, unnest(g) AS gram FROM bound),
templates AS (SELECT template, license, len(g) AS b, unnest(g) AS gram FROM template_grams),
shared AS (
  SELECT doc_id, kind, no, template, license, a, b, count(*) AS shared
  FROM exploded JOIN templates USING (gram) GROUP BY ALL
), good AS (SELECT *, 2.0::DOUBLE * shared / (a + b) AS dice FROM shared WHERE 200 * shared >= {percent} * (a + b))
SELECT doc_id, license, kind, no::INT AS no, shared, a::INT AS unit_bigrams, dice FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, template, kind, no) = 1
"""
