"""Licences of files: what their own text says, or else what their directory inherits.

Lines that speak of a licence, the header of a file, and whole licence files are compared to
templates by the cosine of sparse TF-IDF vectors, joined term by term. The licence files of a directory hold for all
files below it, unless a directory nearer to the file has licence files of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordwood.llm.common import written

# Names of licences and statements that declare them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]

MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    'and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: "
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
    "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE."
)
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
    "specific language governing permissions and limitations under the License."
)
MPL_NOTICE = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
    "of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. "
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)


def _gnu_notice(work: str, name: str, version: str) -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of "
        f"the GNU {name} as published by the Free Software Foundation, either version {version} of "
        f"the License, or (at your option) any later version. This {work} is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
        f"You should have received a copy of the GNU {name} along with this {work}. If not, see "
        "<https://www.gnu.org/licenses/>."
    )


GNU = [
    ("GPL-3.0", "program", "General Public License", "3"),
    ("GPL-2.0", "program", "General Public License", "2"),
    ("LGPL-3.0", "library", "Lesser General Public License", "3"),
    ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("AGPL-3.0", "program", "Affero General Public License", "3"),
]

# Whole notices. Those of licences that differ in few words are all here: the nearest wins.
TEMPLATES += [
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    ("Apache-2.0", APACHE_NOTICE),
    ("MPL-2.0", MPL_NOTICE),
    ("BSD-2-Clause", BSD_GRANT + BSD_REST),
    ("BSD-3-Clause", BSD_GRANT + BSD_NAMES + BSD_REST),
    *((licence, _gnu_notice(work, name, version)) for licence, work, name, version in GNU),
]
# Tags: the name itself, and the older and newer forms of the GNU names.
SPDX_NAMES = {name: [""] for name, _ in TEMPLATES if name != "proprietary"}
SPDX_NAMES |= {name: ["", "+", "-only", "-or-later"] for name, *_ in GNU}
TEMPLATES += [
    (name, f"SPDX-License-Identifier: {name}{form}")
    for name, forms in SPDX_NAMES.items()
    for form in forms
]

# Lines that may declare a licence. Others have none of the terms that tell licences apart.
STATEMENT = r"(?i)licen[cs]|copyright|rights reserved|spdx|permission is|public domain|cc[ -]by|cc0"
# A tag with its name is one term: tags with other names have nothing in common.
TAG = r"spdx-license-identifier\s*:\s*\(?(?=[a-z0-9])"
TERM = r"spdx:[a-z0-9]+(?:[.-]+[a-z0-9]+)*[+]?|[a-z0-9]+"
# What a line of comment begins with; blank lines may be between.
COMMENT = r"^\s*(#|//|\*|--|;|%|$)"
LEAST_COSINE = 0.8
DIGITS = 6


def _terms(unit: Column) -> Column:
    tagged = F.regexp_replace(F.lower(unit), TAG, "spdx:")
    return F.regexp_extract_all(tagged, F.lit(f"({TERM})"))


def best_templates(units: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """The most similar template of every different text: ``unit, licence, score``.

    ``units`` has ``unit``, a digest of the text, ``text`` and ``files``, in how many files it is,
    grouped by ``unit``: their terms are counted where they are. A term weighs by
    the share of units, counted by files, that have it; a term that no template has weighs like
    the rarest. Texts without a template above ``LEAST_COSINE`` are left out.
    """
    spark: SparkSession = units.sparkSession
    known = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template int, licence string, statement string",
    )
    term_counts = known.select("template", "licence", F.explode(_terms(F.col("statement"))).alias("term"))
    term_counts = term_counts.groupBy("template", "licence", "term").agg(F.count("*").alias("t"))
    # The vocabulary: terms of the templates, a parameter and no larger.
    vocabulary = term_counts.select("term").distinct()
    unit_terms = units.select("unit", "files", F.explode(_terms(F.col("text"))).alias("term"))
    unit_terms = unit_terms.groupBy("unit", "term").agg(
        F.max("files").alias("files"), F.count("*").alias("u")
    )
    unit_terms = written(unit_terms, "unit-terms")
    total = F.lit(units.agg(F.sum("files")).first()[0] or 0)
    found = unit_terms.groupBy("term").agg(F.sum("files").alias("df"))
    weights = vocabulary.join(found, "term", "left").select(
        "term", (F.log((1 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
    )
    weights = F.broadcast(written(weights, "term-weights"))
    rarest = F.log(1 + total) + 1

    own = term_counts.join(weights, "term").withColumn("tw", F.col("t") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("tw") * F.col("tw")).over(Window.partitionBy("template")))
    own = own.select("template", "licence", "term", (F.col("tw") / norm).alias("tw"))
    weighed = unit_terms.join(weights, "term", "left").select(
        "unit", "term", (F.col("u") * F.coalesce("idf", rarest)).alias("uw")
    )
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("uw") * F.col("uw"))).alias("norm"))
    dots = weighed.join(F.broadcast(own.drop("licence")), "term").groupBy("unit", "template").agg(
        F.sum(F.col("uw") * F.col("tw")).alias("dot")
    )
    named = F.broadcast(known.select("template", "licence"))
    scored = dots.join(norms, "unit").join(named, "template").select(
        "unit", "licence", F.round(F.col("dot") / F.col("norm"), DIGITS).alias("score")
    )
    scored = scored.where(F.col("score") >= LEAST_COSINE)
    # The highest score, then the first name.
    best = F.min(F.struct((-F.col("score")).alias("order"), "licence", "score"))
    return scored.groupBy("unit").agg(best.alias("best")).select(
        "unit", "best.licence", "best.score"
    )


def named_texts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Templates from files of whole licences, one each, named as the file without its ending.

    For ``scan(..., templates=[*TEMPLATES, *named_texts(...)])``. The texts pass through the driver: a
    list of licences is a parameter, and small.
    """
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
    return sorted((r["name"].removesuffix(".txt"), r["value"]) for r in rows.collect())


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _leading(lines: Column, inside) -> Column:
    """The lines before the first that is not ``inside``, joined."""
    end = F.array_position(F.transform(lines, inside), False)
    return F.array_join(F.when(end > 0, F.slice(lines, 1, end - 1)).otherwise(lines), "\n")


def _header(text: Column) -> Column:
    """The header of a text: its first comment, or else its lines up to the first blank one."""
    text = F.regexp_replace(text, r"^\s+", "")
    # A line that tells how to run or read the file is not part of the comment.
    rest = F.regexp_replace(text, r"^(#!|<\?)[^\n]*\n\s*", "")
    lines = F.split(rest, "\n")
    return (
        F.when(rest.startswith("/*"), F.substring_index(rest, "*/", 1))
        .when(rest.startswith("<!--"), F.substring_index(rest, "-->", 1))
        .when(rest.startswith('"""'), F.substring_index(rest, '"""', 2))
        .when(rest.startswith("'''"), F.substring_index(rest, "'''", 2))
        .when(
            F.rlike(F.element_at(lines, 1), F.lit(COMMENT)),
            _leading(lines, lambda line: F.rlike(line, F.lit(COMMENT))),
        )
        .otherwise(_leading(lines, lambda line: F.rlike(line, F.lit(r"\S"))))
    )


def scan(
    files: DataFrame,
    key: str = "doc_id",
    path: str = "path",
    text: str = "text",
    is_licence: str = "is_licence",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """The licence of every file, one row per row.

    Returns ``doc_id, path, own_licence, own_score, licence, inherited_from``: what the text of
    the file declares, if anything, and what holds for it: that, or else the licence of the
    nearest directory above with licence files, and that directory. Where a file declares
    several, or a directory has several licence files, what a whole text says goes before what a header
    says, and that before what a line says; then the highest score wins, then the first
    name. Licence files are rows where ``is_licence`` is true.

    What is compared are lines, the header (the first comment, or the lines up to a blank one) and,
    of licence files, the whole text; of each only what speaks of a licence.

    Null texts declare nothing; files with a null path inherit nothing; null ids, repeated rows
    and repeated paths come out as they went in. Other columns are not read.
    """
    known = F.coalesce(F.col(is_licence), F.lit(False))
    whole = F.coalesce(F.col(text), F.lit(""))
    units = F.concat(
        F.split(whole, "\n"),
        F.array(_header(whole)),
        F.when(known, F.array(whole)).otherwise(F.array().cast("array<string>")),
    )
    # Most texts have no line that may declare a licence: those are not taken apart.
    may = F.rlike(whole, F.lit(STATEMENT))
    units = F.when(may, F.filter(units, lambda unit: F.rlike(unit, F.lit(STATEMENT))))
    read = files.select(
        F.col(key).alias("doc_id"),
        F.col(path).alias("path"),
        known.alias("is_licence"),
        units.alias("lines"),
        F.when(known, _digest(whole)).alias("whole"),
        _digest(_header(whole)).alias("header"),
    )
    # Only what may declare a licence is kept of the texts.
    read = written(read.withColumn("lines", F.array_distinct("lines")), "statements")
    lines = read.select("doc_id", "path", "is_licence", "whole", "header", F.explode("lines").alias("text"))
    # Whole texts are long: what is counted and joined is their digest.
    lines = lines.withColumn("unit", _digest(F.col("text")))
    kind = F.when(F.col("unit") == F.col("whole"), 0).when(F.col("unit") == F.col("header"), 1).otherwise(2)
    lines = lines.withColumn("kind", kind).drop("whole", "header")
    units = lines.groupBy("unit").agg(F.min("text").alias("text"), F.count("*").alias("files"))
    best = written(best_templates(units, templates), "best")

    stated = lines.join(best, "unit").select(
        "doc_id",
        "path",
        "is_licence",
        F.struct("kind", (-F.col("score")).alias("order"), "licence", "score").alias("found"),
    )
    own = stated.groupBy("doc_id", "path").agg(F.min("found").alias("found"))
    own = own.select(
        F.col("doc_id").alias("d"),
        F.col("path").alias("p"),
        F.col("found.licence").alias("own_licence"),
        F.col("found.score").alias("own_score"),
    )
    declared = stated.where("is_licence AND path IS NOT NULL").select(
        _directory(F.col("path")).alias("above"), "found"
    )
    declared = declared.groupBy("above").agg(F.min("found").alias("found"))
    declared = declared.select("above", F.col("found.licence").alias("licence"))

    # Directories inherit, each once, however many files they hold.
    directories = read.where("path IS NOT NULL").select(
        _directory(F.col("path")).alias("directory")
    ).distinct()
    names = F.split("directory", "/")
    ancestors = directories.select(
        "directory",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size(names)),
                lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(names, 1, i), "/").alias("above")),
            )
        ).alias("a"),
    ).select("directory", "a.depth", "a.above")
    inherited = ancestors.join(declared, "above").groupBy("directory").agg(
        F.max(F.struct("depth", "above", "licence")).alias("nearest")
    )
    inherited = written(
        inherited.select(
            "directory",
            F.col("nearest.licence").alias("inherited"),
            F.col("nearest.above").alias("above"),
        ),
        "inherited",
    )
    placed = read.select("doc_id", "path", _directory(F.col("path")).alias("directory"))
    placed = placed.join(inherited, "directory", "left")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("path").eqNullSafe(F.col("p"))
    done = placed.join(written(own, "own"), same, "left")
    return done.select(
        "doc_id",
        "path",
        "own_licence",
        "own_score",
        F.coalesce("own_licence", "inherited").alias("licence"),
        F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from"),
    )
