"""Licences of files: TF-IDF cosine of headers, statements and whole files to templates, and inheritance from the nearest
directory.

A text is compared as a whole, paragraph by paragraph, and sentence by sentence (also cut at line ends), with or without
marks of a licence: only units whose words rule out the least cosine (`Reach`) are left out before the join. Where units
of a text are equally near, one with marks enough for its kind is named (`MARKS`; `LONG_MARKS` for units longer than a
sentence), so that a notice that takes one sentence is found as that sentence. Units become sparse vectors of term frequency times inverse document frequency (over the templates; a term that no template has weighs most), and their cosine to every
template is one join with the templates' terms. One telling term in common is no licence ("mit" is a German word); two at
least are asked for. A file's licence is its best unit's. A licence file speaks for its directory; a file without a
licence of its own takes that of the nearest directory above it, found by joining the directories' ancestors with those
of licence files, so that a directory is looked up once and not once a file.

Templates are the tags of the SPDX list, usual notices, the standard headers, the whole texts of the short licences, and
the openings of the long ones.

Defined results: a null text is an empty text and has no licence of its own; a null path is the path "", in the root;
rows of one path with different texts are files of their own; of equal cosines the licence first in name holds, and of
two licence files in a directory the better, then the first in path; repeated rows each get the result; an empty table
gives no rows; columns with the names of the results are replaced.
"""
from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtide.cluster import materialise

#: Licences and their tags in the public list of licence identifiers.
SPDX = {
    "0BSD": ["0BSD"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"],
    "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "BSL-1.0": ["BSL-1.0"], "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC0-1.0": ["CC0-1.0"], "EPL-2.0": ["EPL-2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"], "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"],
    "Unlicense": ["Unlicense"], "Zlib": ["Zlib"],
}

_AS_IS = ("IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
          "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
          "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
          "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
          "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
          "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
          "POSSIBILITY OF SUCH DAMAGE.")
_TWO = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.")
_GNU = ("This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
        "Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {thing} is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} "
        "along with this {thing}. If not, see <https://www.gnu.org/licenses/>.")
_VERBATIM = ("GNU {name} Version {v}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and "
             "distribute verbatim copies of this license document, but changing it is not allowed.")
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License."

#: Fixed values: (licence, text) of usual notices, standard headers, whole texts and openings.
NOTICES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format(thing="program", name="Affero General Public License", v="3")),
    ("AGPL-3.0", _VERBATIM.format(name="AFFERO GENERAL PUBLIC LICENSE", v="3", date="19 November 2007", year="2007")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, "
                   "AND DISTRIBUTION"),
    ("BSD-2-Clause", _TWO + " THIS SOFTWARE " + _AS_IS),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", _TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission. THIS SOFTWARE " + _AS_IS),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                "https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", _CC.format(name="Attribution")), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial")), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike")), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work "
                "to the public domain worldwide. This work is published under CC0 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
                "available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(thing="program", name="General Public License", v="2")),
    ("GPL-2.0", _VERBATIM.format(name="GENERAL PUBLIC LICENSE", v="2", date="June 1991", year="1989, 1991")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(thing="program", name="General Public License", v="3")),
    ("GPL-3.0", _VERBATIM.format(name="GENERAL PUBLIC LICENSE", v="3", date="29 June 2007", year="2007")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
            "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
            "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
            "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
            "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format(thing="library", name="Lesser General Public License", v="2.1")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(thing="library", name="Lesser General Public License", v="3")),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
            "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
            "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "This software is proprietary and confidential. Unauthorized copying, distribution or use of this file, via any medium, is "
                    "strictly prohibited. All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
                  "or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
             "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
             "software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be "
             "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or "
             "altered from any source distribution."),
]
TEMPLATES = NOTICES + [(name, f"SPDX-License-Identifier: {tag}") for name, tags in SPDX.items() for tag in tags]

#: Marks of a licence.
MARKS = ["licen[sc]e", "licensed", "copyright", "permission", "warrant(?:y|ies)", "redistribut", "merchantability", "public domain",
         "rights reserved", "creative commons", "free software", "\\bcc[ -]?(?:by|0)\\b", "\\bcc0"]
#: Ordinary English words, which tell no licence.
COMMON = frozenset("a all an and any are as at be been but by can do for form from has have if in is it its may not of on or other source "
                   "such that the their they this to under use used was which with without work you your".split())
LEAST, LONG_MARKS = 0.6, 3


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def template_vectors(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[tuple]]:
    """idf by term, idf of unknown terms, and the templates' unit vectors as (template, licence, term, weight, telling)."""
    bags = [(name, Counter(terms(t))) for name, t in templates]
    seen = Counter(t for _, b in bags for t in b)
    most = math.log(1 + len(bags)) + 1
    idf = {t: math.log((1 + len(bags)) / (1 + k)) + 1 for t, k in seen.items()}
    rows = []
    for k, (name, bag) in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(k, name, t, n * idf[t] / norm, int(t not in COMMON and not (t.isdigit() and len(t) < 2)))
                 for t, n in sorted(bag.items())]
    return idf, most, rows


#: Ends of sentences and lines; lines without a letter or digit between paragraphs.
SENTENCE_END = r"(?<=[.!?])[ \t\n\r\f\x0B]+|[\r\n]+"
PARAGRAPH_END = r"\r?\n[^A-Za-z0-9\n]*\n"


@dataclass(frozen=True)
class Reach:
    """What a unit needs to come up to `least` with any template, told from its words alone. Its product with a template is
    at most the norm of its known words, and at most their sum with each word's largest weight in any template."""
    terms: dict[str, tuple[float, float]]       # squared idf; idf times the largest weight
    telling: tuple[str, ...]
    unknown: float                              # squared idf of unknown terms
    least: float

    @classmethod
    def of(cls, idf: dict[str, float], most: float, rows: list[tuple], least: float) -> "Reach":
        top: dict[str, float] = {}
        for _, _, t, w, _ in rows:
            top[t] = max(top.get(t, 0.0), w)
        return cls({t: (v * v, v * top[t]) for t, v in idf.items()}, tuple(sorted({t for _, _, t, _, tells in rows if tells})),
                   most * most, least - 1e-5)   # cosines are rounded before they are compared

    def keeps(self, words: Column, known: Column) -> Column:
        """Whether a unit of these `words`, of which `known` stand in templates, is to be compared."""
        worth = F.create_map(*[F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("sq"), F.lit(x[1]).alias("dot"))
                               for kv in self.terms.items() for x in kv])

        def state(t: Column, n: Column, of: Column, sq: Column, dot: Column) -> Column:
            return F.struct(t.alias("t"), n.alias("n"), of.alias("of"), sq.alias("sq"), dot.alias("dot"))

        def new(a: Column, t: Column) -> Column:
            return F.transform(F.array(F.element_at(worth, t)), lambda of: state(
                t, F.lit(1.0), of, a["sq"] + of["sq"], a["dot"] + of["dot"]))[0]

        def add(a: Column, t: Column) -> Column:
            return F.when(a["t"] == t, state(t, a["n"] + 1, a["of"], a["sq"] + (2 * a["n"] + 1) * a["of"]["sq"],
                                             a["dot"] + a["of"]["dot"])).otherwise(new(a, t))

        start = state(F.lit(""), F.lit(0.0), F.struct(F.lit(0.0).alias("sq"), F.lit(0.0).alias("dot")), F.lit(0.0), F.lit(0.0))
        rest = F.filter(words, lambda t: ~t.isin(*self.terms))
        # n words of d kinds have squared frequencies of n * n / d at least
        strange = F.size(rest) * F.size(rest) / F.greatest(F.size(F.array_distinct(rest)), F.lit(1)) * self.unknown
        near = F.aggregate(F.array_sort(known), start, add, lambda a: F.exists(F.array(strange), lambda u: (
            F.least(F.sqrt(a["sq"]), a["dot"]) >= self.least * F.sqrt(a["sq"] + u))))
        return (F.size(F.array_distinct(F.filter(known, lambda t: t.isin(*self.telling)))) > 1) & near


def units(files: DataFrame, reach: Reach, path: str, text: str) -> DataFrame:
    """(_key, _kind, _n, _s, _weak): whole text (0), paragraphs (1) and sentences (2) of the different files, without those
    that cannot come up to any template; _weak: fewer marks of a licence than a notice of its kind has."""
    def of(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    paragraphs = F.split(F.col(text), PARAGRAPH_END)
    parts = F.concat(of(0, F.array(F.col(text))), F.filter(of(1, paragraphs), lambda u: F.size(paragraphs) > 1),
                     of(2, F.split(F.col(text), SENTENCE_END)))
    words = F.transform(parts, lambda u: F.struct(u["kind"].alias("kind"), u["s"].alias("s"), F.filter(
        F.split(F.lower(u["s"]), "[^a-z0-9]+"), lambda t: t != "").alias("words")))
    known = F.transform(words, lambda u: F.struct(u["kind"].alias("kind"), u["s"].alias("s"), u["words"].alias("words"), F.filter(
        u["words"], lambda t: t.isin(*reach.terms)).alias("known")))
    found = F.transform(F.filter(known, lambda u: reach.keeps(u["words"], u["known"])), lambda u: F.struct(
        u["kind"].alias("kind"), u["s"].alias("s")))
    marks = sum((F.col("_s").rlike(f"(?i){m}").cast("int") for m in MARKS), F.lit(0))
    return (files.filter(F.col(text).isNotNull()).select(key_of(path, text).alias("_key"), found.alias("_found"))
            .filter(F.size("_found") > 0).dropDuplicates(["_key"])
            .select("_key", F.posexplode("_found").alias("_n", "_u")).select("_key", "_n", "_u.kind", "_u.s")
            .withColumnsRenamed({"kind": "_kind", "s": "_s"})
            .withColumn("_weak", marks < F.when(F.col("_kind") < 2, LONG_MARKS).otherwise(1)))


def key_of(path: str, text: str) -> Column:
    """A file is a path and a text."""
    return F.sha2(F.concat_ws("\0", F.col(path), F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)


def _table(spark: SparkSession, rows: list[tuple], columns: tuple[str, ...]) -> DataFrame:
    """A constant table that the JVM reads from one literal, so that no Python worker takes part."""
    names = [c.split()[0] for c in columns]
    kind = f"array<struct<{', '.join(c.replace(' ', ': ') for c in columns)}>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), kind)))


def own_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, path: str = "path",
                 text: str = "text") -> DataFrame:
    """(_key, license, cosine, license_unit) of files with a unit at `least` or more; license_unit is whole, paragraph or
    sentence."""
    spark = files.sparkSession
    idf, most, rows = template_vectors(templates)
    vectors = F.broadcast(_table(spark, rows, ("_m int", "license string", "_t string", "_w double", "_tells int")))   # the templates' terms
    weights = F.broadcast(_table(spark, sorted(idf.items()), ("_t string", "_idf double")))
    told = units(files.select(path, text), Reach.of(idf, most, rows, least), path, text)
    bags = (told.select("_key", "_n", "_kind", "_weak", F.explode(F.filter(F.split(F.lower("_s"), "[^a-z0-9]+"), lambda t: t != "")).alias("_t"))
            .groupBy("_key", "_n", "_kind", "_weak", "_t").agg(F.count("*").alias("_tf"))
            .join(weights, "_t", "left").withColumn("_v", F.col("_tf") * F.coalesce("_idf", F.lit(most))))
    norms = bags.groupBy("_key", "_n").agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    dots = bags.join(vectors, "_t").groupBy("_key", "_n", "_kind", "_weak", "_m", "license").agg(
        F.sum(F.col("_v") * F.col("_w")).alias("_dot"), F.sum("_tells").alias("_tells")).filter("_tells > 1")
    best = (dots.join(norms, ["_key", "_n"]).withColumn("cosine", F.round(F.col("_dot") / F.col("_norm"), 6))
            .filter(F.col("cosine") >= least)
            .groupBy("_key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license", "_weak", "_kind")).alias("_b")))
    return best.select("_key", "_b.license", (-F.col("_b.c")).alias("cosine"),
                       F.element_at(F.array(*map(F.lit, ("whole", "paragraph", "sentence"))), F.col("_b._kind") + 1).alias("license_unit"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(folder: Column) -> Column:
    """The directory and all above it, the root being ""."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(
        d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir")))


def scan(files: DataFrame, licence_file: Column, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST,
         path: str = "path", text: str = "text") -> DataFrame:
    """`files` without the text, with own_license, cosine, license_unit, license and inherited_from (a directory, or null).

    `licence_file` says, over the columns of `files` and license_unit, which files with a licence speak for their
    directory.
    """
    rows = files.drop("license", "cosine", "license_unit", "own_license", "inherited_from", "_key", "_dir", "_speaks").withColumn(
        path, F.coalesce(F.col(path), F.lit("")))
    own = materialise(own_licenses(rows, templates, least, path, text))
    known = rows.withColumn("_key", key_of(path, text)).join(own, "_key", "left").withColumn("_dir", directory(F.col(path)))
    known = materialise(known.withColumn("_speaks", F.coalesce(licence_file & F.col("license").isNotNull(), F.lit(False)))
                        .drop(text, "_key"))
    spoken = (known.filter("_speaks").withColumn("dir", F.array_join(F.filter(F.split("_dir", "/"), lambda p: p != ""), "/"))
              .groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col(path).alias("p"), "license")).alias("_b"))
              .select("dir", F.col("_b.license").alias("_given")))
    above = known.select("_dir").distinct().select("_dir", F.explode(_ancestors(F.col("_dir"))).alias("_a"))
    nearest = materialise(above.select("_dir", "_a.depth", "_a.dir").join(spoken, "dir").groupBy("_dir").agg(
        F.max(F.struct("depth", "dir", "_given")).alias("_g")))
    free = F.col("license").isNull()
    return (known.join(nearest, "_dir", "left")
            .withColumn("inherited_from", F.when(free, F.col("_g.dir")))
            .withColumn("own_license", F.col("license"))
            .withColumn("license", F.coalesce("own_license", "_g._given"))
            .drop("_dir", "_g", "_speaks"))
