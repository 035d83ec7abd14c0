"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

A text is compared in units: its statements (lines, and sentences within lines), its
paragraphs (blocks between lines without a letter or digit, so that a wrapped header in a comment is one), and
as a whole. A unit is a sparse vector of term frequency times inverse document frequency,
idf(t) = ln((1 + N) / (1 + df(t))) + 1, where df counts the files with the term, all N of them;
a term that no template has counts as one of a single file. The best cosine with a
template, if it reaches `least`, gives the unit's licence, and the best unit the file's own
(ties: the licence's name, then statements before paragraphs before the whole, then the first).

A file whose whole text reaches `least` is a licence file: it speaks for the directory
that it stands in. Other files without a licence of their own inherit from the nearest
ancestor directory that has a licence file (of several, the best, then the smallest
path), by joins of paths: every directory names its ancestors, and the deepest one with
a licence file wins.

Candidates are pruned by a bound that loses nothing: of each template's unit vector, the
heaviest terms are set apart until the rest has a length below `least`; a unit without any
of these has a cosine below `least` with it.

Everything is DataFrame functions; templates are a small fixed set, and what comes to the
driver is one count for each of their terms. Null texts count as empty and null paths as the root; files without
any licence in reach get a null licence. Repeated rows are scanned alike; texts are taken whole, whatever
their length; an empty table gives no rows. Files are told apart by path and a hash of the text. All
columns but the text pass by; one that has the name of a result is given as input_<name>.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import fits, text_of, written

#: Texts of public licences, and the notices by which they are commonly declared.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_CLOSING = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
TEMPLATES = (
    ("MIT", "MIT License"), ("MIT", "Released under the MIT License."), ("MIT", _MIT), ("MIT", _MIT.split("\n")[0]),
    ("BSD-2-Clause", f"{_BSD_OPENING}\n\n{_BSD_CLOSING}"), ("BSD-3-Clause", f"{_BSD_OPENING} {_BSD_THIRD}\n\n{_BSD_CLOSING}"), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", _ISC), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE.split("\n")[0]),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", _GNU.format(_GPL, "either version 2")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GNU.format(_GPL, "either version 3")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."), ("LGPL-3.0", _GNU.format(_LGPL, "either version 3")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."), ("AGPL-3.0", _GNU.format(_AGPL, "either version 3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", _MPL), ("MPL-2.0", _MPL.split(". If")[0]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def templates() -> list[tuple[str, str]]:
    """(licence, text): TEMPLATES, and the identifier line of each licence."""
    return [*TEMPLATES, *[(name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES})]]


_TERM_SPLIT, _TRIMMED = r"[^a-z0-9.+-]+", ".+-"
_STATEMENT_SPLIT, _PARAGRAPH_SPLIT = r"\n|(?<=[.!?])\s+", r"\n[^a-zA-Z0-9\n]*\n"
#: Names of the results.
RESULTS = ("own_license", "own_score", "n_statements", "is_license_file", "license", "inherited_from")


def terms_of(text: str) -> list[str]:
    """Terms of a template, as the Spark side makes them of units."""
    return [t for t in (x.strip(_TRIMMED) for x in re.split(_TERM_SPLIT, text.lower())) if t]


def _terms(text: Column, once: bool = False) -> Column:
    raw = F.split(F.lower(text), _TERM_SPLIT)
    return F.filter(F.transform(F.array_distinct(raw) if once else raw, lambda t: F.btrim(t, F.lit(_TRIMMED))), lambda t: t != "")


def document_counts(files: DataFrame, given: list[tuple[str, str]]) -> tuple[int, dict[str, int]]:
    """The number of files (_text), and of those with each term of the templates."""
    vocabulary = sorted({t for _, text in given for t in terms_of(text)})
    known = F.array_intersect(_terms(F.col("_text"), once=True), F.lit(vocabulary))
    n = files.count()
    return n, {r["term"]: r["df"] for r in files.select(F.explode(known).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}


def template_weights(given: list[tuple[str, str]], n: int, counts: dict[str, int]) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, term, normalised weight) rows, idf by term, and the idf of all other terms."""
    idf_of = lambda d: math.log((1 + n) / (1 + d)) + 1
    idf = {t: idf_of(counts.get(t, 0)) for _, text in given for t in terms_of(text)}
    rows = []
    for i, (name, text) in enumerate(given):
        terms = terms_of(text)
        weight = {t: terms.count(t) * idf[t] for t in terms}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(i, name, t, weight[t] / norm) for t in sorted(weight)]
    return rows, idf, idf_of(1)


def needed_terms(weights: list[tuple[int, str, str, float]], least: float) -> list[str]:
    """Terms of which a unit must have one to reach `least`: each template's heaviest, until the rest is shorter than that."""
    needed, rest = set(), {}
    for template, _, term, w in sorted(weights, key=lambda r: (r[0], -r[3], r[2])):
        left = rest.get(template, 1.0)
        if left + 1e-9 >= least * least:
            needed.add(term)
        rest[template] = left - w * w
    return sorted(needed)


def scores(files: DataFrame, least: float = 0.8, given: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file, kind, at, licence, score): the best licence of each unit that reaches `least`; kind 0: statements, 1: paragraphs, 2: the whole. files: file, _text."""
    given = given or templates()
    weights, idf, other = template_weights(given, *document_counts(files, given))
    table = files.sparkSession.createDataFrame(weights, "template int, licence string, term string, weight double")
    known = files.sparkSession.createDataFrame(sorted(idf.items()), "term string, idf double")
    pattern = "(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in needed_terms(weights, least)) + ")(?![a-z0-9])"
    may = lambda text: F.lower(text).rlike(pattern)
    unit = lambda kind: lambda part, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), part.alias("part"))
    text = F.col("_text")
    paragraphs = F.split(text, _PARAGRAPH_SPLIT)
    units = F.concat(F.transform(F.split(text, _STATEMENT_SPLIT), unit(0)), F.when(F.size(paragraphs) > 1, F.transform(paragraphs, unit(1))).otherwise(F.expr("cast(array() as array<struct<kind:int,at:int,part:string>>)")), F.array(unit(2)(text, F.lit(0))))
    each = files.where(may(text)).select("file", F.inline(F.filter(units, lambda u: may(u["part"]))))
    keys = ["file", "kind", "at"]
    counted = each.select(*keys, F.explode(_terms(F.col("part"))).alias("term"))
    # Repeated rows add to all counts alike, which a cosine doesn't see.
    tf = counted.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")).join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(F.broadcast(table), "term").groupBy(*keys, "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dot.join(norm, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= least)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence"))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def _kept_names(columns: list[str]) -> dict[str, str]:
    """Names under which input columns are given: their own, or input_<name> where a result has it."""
    out, taken = {}, {*RESULTS, *columns}
    for c in columns:
        name = c
        while name in RESULTS or (name != c and name in taken):
            name = f"input_{name}"
        out[c] = name
    return out


def scan(files: DataFrame, path_col: str, text_col: str, least: float = 0.8, given: list[tuple[str, str]] | None = None, few: int = 1_000_000) -> DataFrame:
    """files' columns but the text, and: own_license, own_score, n_statements (that reach `least`), is_license_file, license, inherited_from (a directory, or null)."""
    path, text = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("/")), text_of(text_col)
    own = files.select(F.struct(path.alias("path"), F.xxhash64(text).alias("hash")).alias("file"), text.alias("_text"))
    first = F.min(F.struct((-F.col("score")).alias("minus"), "licence", "kind", "at"))
    per_file = scores(own, least, given).groupBy("file").agg(first.alias("b"), F.count_if(F.col("kind") == 0).alias("n"), F.bool_or(F.col("kind") == 2).alias("is_file"))
    per_file = written(per_file.select(F.col("file.path").alias("_path"), F.col("file.hash").alias("_hash"), F.struct(F.col("b.licence").alias("licence"), (-F.col("b.minus")).alias("score"), "n", "is_file").alias("_own")), "licences")
    ranked = F.min(F.struct((-F.col("_own.score")).alias("minus"), "_path", F.col("_own.licence").alias("licence")))
    speaking = per_file.where("_own.is_file").groupBy(_parent(F.col("_path")).alias("ancestor")).agg(ranked.alias("given"))
    # One struct holds all columns of the input, so that none of their names can clash with those made here.
    names = _kept_names([c for c in files.columns if c != text_col])
    keyed = files.select(F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_in"), path.alias("_path"), F.xxhash64(text).alias("_hash"), _parent(path).alias("_dir"))
    # Directories, and each one's ancestors by its path: one row per directory and level, not per file.
    places = files.select(_parent(path).alias("_dir")).distinct()
    parts = F.split(F.col("_dir"), "/")
    ancestors = places.select("_dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("ancestor"))
    deepest = F.max(F.struct(F.length("ancestor").alias("long"), "ancestor", F.col("given.licence").alias("licence")))
    nearest = written(ancestors.join(speaking, "ancestor").groupBy("_dir").agg(deepest.alias("_near")), "nearest")
    full = keyed.join(F.broadcast(per_file) if fits(per_file, few) else per_file, ["_path", "_hash"], "left").join(F.broadcast(nearest) if fits(nearest, few) else nearest, "_dir", "left")
    licence = F.col("_own.licence")
    inherited = F.when(licence.isNull(), F.when(F.col("_near.ancestor") == "", "/").otherwise(F.col("_near.ancestor")))
    results = (licence, F.col("_own.score"), F.coalesce("_own.n", F.lit(0)).cast("long"), F.coalesce("_own.is_file", F.lit(False)), F.coalesce(licence, F.col("_near.licence")), inherited)
    return full.select(*[F.col(f"_in.c{i}").alias(name) for i, name in enumerate(names.values())], *[c.alias(n) for c, n in zip(results, RESULTS, strict=True)])


def path_of_documents(docs: DataFrame) -> DataFrame:
    """The documents table as a tree of files: /source/lang/doc_id, the null parts as '-'."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return docs.select("doc_id", F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id")).alias("path"), "text")
