"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

The passages of a file that are compared, where it names a licence at all:

* every line that names one in some way;
* every comment, be it ``/* … */`` or a run of commented lines, and each of its paragraphs: wrapped headers;
* the whole text and its paragraphs, if the file is called like a licence file or holds the wording of one (``WORDING``);
* every ``SPDX-License-Identifier``, as one term; of an expression the first identifier.

A passage is the sequence of its terms, so wrapping, comment marks and letter
case do not matter.  Each different passage is compared once with the
templates as a sparse vector of its terms, weighed by their rarity among all
different passages and templates.  A file has the licence of its best passage.

A licence file speaks for its directory: one that is called like it, whose
whole text is near a template, or that consists of lines which state a licence
outside comments for at least ``LICENSE_SHARE`` of its words.  Source code (by
its extension) never is one.  Other files without a licence of their own take
that of the nearest directory above them that has one; the root is ``''``.

DataFrame functions only.  Null texts hold no passage; rows without a path
get no licence.  Rows with the same path are one file, and each gets its
result; ties go to the licence, then the path that sorts first.  Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lanelytics.llm.common import stored

# The words of licences, and of the notices by which texts state them.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. "
)
_BSD = (
    "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS "
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You "
    "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_MOZILLA = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    """Fixed wording: the first paragraph of the notice of a GNU licence, and the whole."""
    name = f"GNU {kind} Public License"
    first = (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
    )
    rest = (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the "
        f"{name} along with this program. If not, see https://www.gnu.org/licenses/."
    )
    return first, first + rest


#: Short notices by which texts state a licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Titles of licences, and their own words or long notices.
TEXTS = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero General", "3")),
    "Apache-2.0": ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _APACHE),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD + _BSD_END),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD + _BSD_THIRD + _BSD_END),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal public domain dedication",),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("General", "2")),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("General", "3")),
    "ISC": ("ISC License", _ISC),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", *_gnu("Lesser General", "2.1")),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("Lesser General", "3")),
    "MIT": ("MIT License", _MIT + _WARRANTY),
    "MPL-2.0": ("Mozilla Public License Version 2.0", _MOZILLA),
}
#: Ends that identifiers may have beside the name of the licence.
TAG_ENDS = ("", "+", "-only", "-or-later")
#: What a passage must hold to count as a statement, what only the text of a licence holds, what a term and an identifier are.
STATEMENT = r"(?i)licen[cs]|copyright|public domain|\bcc0\b|\bspdx\b|\bgpl\b"
WORDING = (
    r"(?i)permission\s+is\s+hereby\s+granted|redistribution\s+and\s+use\s+in|permission\s+to\s+use,\s+copy"
    r"|terms\s+and\s+conditions\s+for|international\s+public\s+license|mozilla\s+public\s+license\s+version"
)
TERM, TAG = r"[a-z0-9]+(?:\.[0-9]+)*", r"spdx-license-identifier:[ \t]*[(]?([a-z0-9.+-]+)"
#: Lines that are comments, lines between paragraphs, names of licence files and of source code.
COMMENT, BETWEEN = r"^[ \t]*(?://|/\*|\*|#|--|;|%|<!--|dnl\b|rem\b)", r"\n[^A-Za-z0-9\n]*\n"
NAMED = r"(?i)(?:^|/)(?:[^/]*[-_.])?(?:licen[cs]es?|copying|unlicense)(?:[-_.][^/]*)?$"
CODE = r"(?i)\.(?:c|cc|cpp|cs|css|go|h|hpp|java|js|json|kt|php|pl|py|r|rb|rs|scala|sh|sql|swift|toml|ts|xml|ya?ml)$"
#: The least cosine, and the least share of words in lines that state a licence.
LEAST, LICENSE_SHARE = 0.7, 0.2


def passage(text: Column) -> Column:
    """The terms of a text, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(TERM), 0), " ")


def _weighed(counts: DataFrame, rarity: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, term, weight) of unit length from (keys, term, times)."""
    weight = (1 + F.log("times")) * F.col("idf")
    weighed = counts.join(rarity, "term").select(*keys, "term", weight.alias("weight"))
    lengths = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    return weighed.join(lengths, keys).select(*keys, "term", (F.col("weight") / F.col("size")).alias("weight"))


def _term_counts(passages: DataFrame, keys: list[str]) -> DataFrame:
    return passages.select(*keys, F.explode(F.split("passage", " ")).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("times"))


def wordings(templates: dict[str, str] = TEMPLATES, texts: dict[str, tuple[str, ...]] = TEXTS) -> list[tuple[str, int, str]]:
    """(license, number, text) of all templates."""
    return [(name, n, text) for name in sorted(templates) for n, text in enumerate((templates[name], *texts.get(name, ())))]


def template_passages(spark: SparkSession, known: list[tuple[str, int, str]]) -> DataFrame:
    """(license, number, passage) of templates and of the identifiers of their licences."""
    notices = [F.struct(F.lit(name).alias("license"), F.lit(n).alias("number"), passage(F.lit(text)).alias("passage")) for name, n, text in known]
    tags = [
        F.struct(F.lit(name).alias("license"), F.lit(-1 - n).alias("number"), F.lit(f"spdx:{name.lower()}{end}").alias("passage"))
        for name in sorted({name for name, _, _ in known})
        for n, end in enumerate(TAG_ENDS)
    ]
    return spark.range(1).select(F.inline(F.array(*notices, *tags)))


def classify(spark: SparkSession, passages: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(passage, license, score) of the different passages (passage) that come near a template."""
    known = stored(template_passages(spark, wordings(templates)))
    of_passage, of_template = _term_counts(passages, ["passage"]), _term_counts(known, ["license", "number"])
    number = passages.count() + known.count()
    idf = F.log((1 + F.lit(number)) / (1 + F.count("*"))) + 1
    weights = stored(of_passage.select("term").unionAll(of_template.select("term")).groupBy("term").agg(idf.alias("idf")))
    # as many rows as the templates have terms
    template_weights = F.broadcast(_weighed(of_template, weights, ["license", "number"]).withColumnRenamed("weight", "w"))
    near = (
        _weighed(of_passage, weights, ["passage"])
        .join(template_weights, "term")
        .groupBy("passage", "license", "number")
        .agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score"))
        .filter(F.col("score") >= LEAST)
    )
    best = F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best")
    return near.groupBy("passage").agg(best).select("passage", "best.license", (-F.col("best.score")).alias("score"))


def _directory(path: str) -> Column:
    """The path without its last name; ``''`` for names in the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _passages() -> Column:
    """Structs (kind, n_words, passage) of the columns text and path; n_words counts where a line is no comment."""
    words = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda word: word != ""))
    states = lambda text: text.rlike(STATEMENT)
    nothing = F.array().cast("array<string>")
    lines = F.split("text", "\n")
    runs = F.split(F.array_join(F.transform(lines, lambda line: F.when(line.rlike(COMMENT), line).otherwise("\x02")), "\n"), "\x02")
    opened = F.split("text", r"/\*")
    closed = F.filter(F.slice(opened, 2, F.greatest(F.size(opened) - 1, F.lit(0))), lambda part: part.contains("*/"))
    comments = F.filter(F.concat(runs, F.transform(closed, lambda part: F.substring_index(part, "*/", 1))), states)
    licence = F.col("path").rlike(NAMED) | F.col("text").rlike(WORDING)
    whole = F.when(licence & ~F.col("path").rlike(CODE), F.array("text")).otherwise(nothing)
    blocks = F.concat(comments, whole)
    paragraphs = F.filter(F.flatten(F.transform(blocks, lambda block: F.split(block, BETWEEN))), states)
    tags = F.regexp_extract_all(F.lower("text"), F.lit(TAG), 1)
    stating = F.filter(lines, lambda line: states(line) & ~F.lower(line).contains("spdx-license-identifier"))

    def rows(kind: str, texts: Column, n_words=lambda text: F.lit(0), of=passage) -> Column:
        return F.transform(texts, lambda text: F.struct(F.lit(kind).alias("kind"), n_words(text).alias("n_words"), of(text).alias("passage")))

    return F.concat(
        rows("line", stating, lambda line: F.when(line.rlike(COMMENT), 0).otherwise(words(line))),
        rows("part", F.concat(comments, paragraphs)),
        rows("whole", whole),
        rows("tag", tags, of=lambda tag: F.concat(F.lit("spdx:"), tag)),
    )


def _own(files: DataFrame) -> DataFrame:
    """(path, own_license, own_score, is_license_file) of files that state a licence."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda word: word != ""))
    stated = stored(
        files.filter(F.col("path").isNotNull() & F.col("text").rlike(STATEMENT))
        .select("path", words.alias("of_words"), F.inline(_passages()))
        .filter(F.col("passage") != "")
    )
    found = stored(classify(files.sparkSession, stored(stated.select("passage").distinct())))
    best = F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best")
    speaks = (
        F.col("path").rlike(NAMED)
        | F.max(F.col("kind") == "whole")
        | (F.sum("n_words") / F.max("of_words") >= LICENSE_SHARE)
    )
    by_path = stated.join(found, "passage").groupBy("path").agg(best, (speaks & ~F.col("path").rlike(CODE)).alias("is_license_file"))
    return by_path.select(
        "path",
        F.col("best.license").alias("own_license"),
        (-F.col("best.score")).alias("own_score"),
        "is_license_file",
    )


def _inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """(directory, inherited, inherited_from): the licence of the nearest directory that has one."""
    speaking = (
        own.filter("is_license_file")
        .withColumn("above", _directory("path"))
        .groupBy("above")
        .agg(F.min(F.struct((-F.col("own_score")).alias("score"), "path", "own_license")).alias("best"))
        .select("above", F.col("best.own_license").alias("inherited"))
    )
    parts = F.split("directory", "/")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    directories = files.filter("path is not null").select(_directory("path").alias("directory")).distinct()
    above = directories.select("directory", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), upward))).alias("above"))
    nearest = F.max(F.struct(F.length("above").alias("depth"), "above", "inherited")).alias("nearest")
    return (
        above.join(speaking, "above")
        .groupBy("directory")
        .agg(nearest)
        .select("directory", "nearest.inherited", F.col("nearest.above").alias("inherited_from"))
    )


def scan(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, path, own_license, own_score, is_license_file, license and inherited_from of every row of files (path, text)."""
    files = files.select(*keys, F.col("path").cast("string").alias("path"), "text")
    own = stored(_own(files))
    inherited = stored(_inherited(files, own))
    rows = files.drop("text").withColumn("directory", _directory("path"))
    return rows.join(own, "path", "left").join(inherited, "directory", "left").select(
        *keys,
        "path",
        "own_license",
        "own_score",
        F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
        F.coalesce("own_license", "inherited").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source, language and a directory for each thousand ids."""
    bucket = F.floor(F.col("doc_id") / 1000).cast("long").cast("string")
    parts = [F.coalesce(part, F.lit("")) for part in (F.col("source"), F.col("lang"), bucket)]
    return docs.withColumn("path", F.concat_ws("/", *parts, F.col("doc_id").cast("string")))
