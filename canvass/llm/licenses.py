"""Licence scans: headers and licence files against templates, and inheritance by directory.

Notices are lines that hold a cue word, the comment that opens a file, and the whole
text of a licence file.  They are compared with templates, short ones and full texts,
by the cosine of sparse TF-IDF vectors, whose document frequencies are counted over
the lines with cue words of the whole corpus.  SPDX identifiers are read as they
stand, and short names of the GPL become one term.  A file without a notice of its own takes the licence
of the nearest directory above it that has a licence file, found by joining paths.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import stage

THRESHOLD = 0.6
CUES = r"(?i)\b(licen[cs]ed?|copyright|spdx|gpl|public domain|all rights reserved)\b"
WORD = "[a-z0-9.]*[a-z0-9]"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Short forms of well-known notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy "
            "of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms, with or "
                     "without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "Copyright. All rights reserved."),
]
TEXTS = Path(__file__).with_name("licence_texts")  # full texts, a file each
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software."""
_NO_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_NO_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as
published by the Free Software Foundation; either version {n} of the License, or (at your option) any later version. This
{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of
the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
#: Blocks: whole headers and licence files, with and without the disclaimer.
BLOCKS = [
    ("MIT", _MIT), ("MIT", "MIT License Copyright (c) " + _MIT + _NO_WARRANTY),
    ("BSD-2-Clause", _BSD), ("BSD-2-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_NO_WARRANTY),
    ("BSD-3-Clause", _BSD + _BSD_THIRD), ("BSD-3-Clause", "Copyright (c) All rights reserved. " + _BSD + _BSD_THIRD + _BSD_NO_WARRANTY),
    ("Apache-2.0", """Copyright Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    *[(licence, _GNU.format(what=what, mark=":", name=name, n=n)) for licence, what, name, n in (
        ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
        ("LGPL-3.0", "library", "Lesser General Public License", "3"),
        ("AGPL-3.0", "program", "Affero General Public License", "3"))],
]
#: Short names of the GNU licences: as they are written, and notices that hold one.
SHORT = r"(?i)(?<![a-z0-9])(a|l)?gpl(?:[ -]?v(?:ersion)?[ .]{0,2}|,? version |[ -])([123](?:\.[0-9])?)(?![0-9])"
SHORT_NAMES = {"gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "lgpl2.1": "LGPL-2.1", "lgpl3": "LGPL-3.0", "agpl3": "AGPL-3.0"}
SHORT_NOTICES = ["{}", "License: {}", "Licensed under the {}.", "Released under the {} license.",
                 "Distributed under the terms of the {} or later."]
SPDX = r"SPDX-License-Identifier:[ \t]*+(\(?[A-Za-z0-9.+-]++(?:\)?[ \t]++(?:AND|OR|WITH)[ \t]++\(?[A-Za-z0-9.+-]++)*+\)?)"
#: The comments that open a text, of any length.
HEADER = (r"^((?:#![^\n]*+\n)?+(?:\s*+(?:/\*(?:[^*]++|\*(?!/))*+\*/|<!--(?:[^-]++|-(?!->))*+-->"
          r"|\"\"\"(?:[^\"]++|\"(?!\"\"))*+\"\"\"|(?:#|//|--|;|%)[^\n]*+))++)")
LINE, NAME, BLOCK = "line", "name", "block"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def notices(files: DataFrame) -> DataFrame:
    """``(row, notice, kind, term, tf)``: what may be a notice, term by term.

    Single lines that hold a cue word, lines with a short name as one term, and the
    opening comment and the whole text of a licence file as blocks.
    """
    spoken = F.coalesce("text", F.lit(""))
    lines = files.where(F.regexp_like(spoken, F.lit(CUES)) | F.regexp_like(spoken, F.lit(SHORT))).select(
        "row", F.posexplode(F.split("text", "\n")).alias("notice", "line"))
    cued = lines.where(F.regexp_like("line", F.lit(CUES))).select(
        "row", "notice", F.lit(LINE).alias("kind"), terms(F.col("line")).alias("ts"))
    # versions such as 2.0 and 2 are one
    short = F.regexp_replace(F.regexp_replace("line", F.lit(SHORT), F.lit(" $1gpl$2 ")), F.lit(r"(?i)(gpl[123])\.0"), F.lit("$1"))
    named = lines.where(F.regexp_like("line", F.lit(SHORT))).select("row", "notice", F.lit(NAME).alias("kind"), terms(short).alias("ts"))
    blocks = files.select("row", F.posexplode(F.array(
        "header", F.when(F.col("is_licence"), F.col("text")))).alias("notice", "block")).where("block is not null")
    blocks = blocks.select("row", "notice", F.lit(BLOCK).alias("kind"), terms(F.col("block")).alias("ts"))
    return cued.unionByName(named).unionByName(blocks).select("row", "notice", "kind", F.explode("ts").alias("term")).groupBy(
        "row", "notice", "kind", "term").agg(F.count(F.lit(1)).alias("tf"))


def all_templates() -> list[tuple[str, str, str]]:
    """``(kind, licence, text)``; lines meet the short templates, blocks these and the full texts."""
    names = [(NAME, licence, text.format(name)) for name, licence in SHORT_NAMES.items() for text in SHORT_NOTICES]
    full = [(BLOCK, path.stem, path.read_text()) for path in sorted(TEXTS.glob("*.txt"))]
    return ([(LINE, *t) for t in TEMPLATES] + names + [(BLOCK, *t) for t in [*TEMPLATES, *BLOCKS]] + full)


def template_terms(spark) -> DataFrame:
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(all_templates())],
                                 "template int, kind string, licence string, body string")
    return rows.select("template", "kind", "licence", F.explode(terms(F.col("body"))).alias("term")).groupBy(
        "template", "kind", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))


def best_notices(files: DataFrame) -> DataFrame:
    """The best licence of each file: ``(row, licence, similarity)``, from the threshold on.

    An SPDX identifier goes first, then a block, a short name or a line that names a licence by
    similarity; that all rights are reserved counts last where a block says more.
    """
    found = stage(notices(files), "notices")
    lines = found.where(F.col("kind") == LINE)
    total = lines.select("row", "notice").distinct().count()
    templates = template_terms(files.sparkSession)
    counted = lines.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((1.0 + total + len(TEMPLATES)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    # the templates' words, a fixed number
    known = stage(templates.join(counted, "term", "left").select(
        "template", "kind", "licence", "term", (F.col("tf") * idf).alias("weight"), idf.alias("idf")), "templates")
    lengths = known.groupBy("template", "licence").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_size"))
    weighed = found.join(counted, "term", "left").withColumn("weight", F.col("tf") * idf)
    sizes = weighed.groupBy("row", "notice", "kind").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("_own"))
    dots = weighed.select("row", "notice", "kind", "term", "weight").join(
        F.broadcast(known.select("template", "kind", "term", F.col("weight").alias("_w"))), ["kind", "term"]).groupBy(
        "row", "notice", "kind", "template").agg(F.sum(F.col("weight") * F.col("_w")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("_size") / F.col("_own"), 6)
    sure = (F.col("kind") != LINE) & (F.col("licence") != "proprietary")
    each = dots.join(F.broadcast(lengths), "template").join(sizes, ["row", "notice", "kind"]).select(
        "row", "licence", cosine.alias("similarity"), sure.cast("int").alias("_sure")).where(F.col("similarity") >= THRESHOLD)
    spdx = F.regexp_extract("text", SPDX, 1)
    stated = files.where(F.coalesce(spdx, F.lit("")) != "").select(
        "row", F.regexp_replace(spdx, F.lit(r"(GPL-[0-9.]+[0-9])(?:-only|-or-later|\+)"), F.lit("$1")).alias("licence"),
        F.lit(1.0).alias("similarity"), F.lit(2).alias("_sure"))
    best = each.unionByName(stated).groupBy("row").agg(F.max(F.struct("_sure", "similarity", "licence")).alias("_b"))
    return best.select("row", "_b.licence", "_b.similarity")


def parents(path: Column) -> Column:
    """All directories above a path, the root being the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame) -> DataFrame:
    """Licences of files ``(doc_id, path, text)``: own, inherited, and the one that holds.

    A licence file speaks for its directory; of several the most similar does, ties by
    name.  A null text has no notice; a null path has no directory and inherits
    nothing.  Repeated rows are judged each for itself; no rows give none.  Other
    columns are left out.
    """
    rows = files.select("doc_id", "path", "text", F.monotonically_increasing_id().alias("row"))
    name, directory = F.element_at(F.split("path", "/"), -1), F.element_at(parents(F.col("path")), -1)
    header = F.regexp_extract("text", HEADER, 1)
    spoken, licence_file = F.coalesce("text", F.lit("")), F.coalesce(F.regexp_like(name, F.lit(LICENCE_FILE)), F.lit(False))
    narrow = stage(rows.select(
        "doc_id", "path", "row", licence_file.alias("is_licence"), F.when(header != "", header).alias("header"),
        F.when(F.regexp_like(spoken, F.lit(CUES)) | F.regexp_like(spoken, F.lit(SHORT)) | licence_file, F.col("text")).alias("text")), "files")
    own = stage(best_notices(narrow), "own")
    named = narrow.drop("text", "header").join(own, "row", "left")
    named = stage(named.withColumn("dir", directory), "named")
    speaks = named.where("is_licence and licence is not null").groupBy(F.col("dir").alias("above")).agg(
        F.max(F.struct("similarity", "licence")).alias("_s"))
    # directories, not files, are joined with those above them
    up = named.where("dir is not null").select("dir").distinct().select(
        "dir", F.explode(F.array_append(parents(F.col("dir")), F.col("dir"))).alias("above"))
    nearest = up.join(speaks, "above").groupBy("dir").agg(
        F.max(F.struct(F.length("above").alias("depth"), F.col("above"), F.col("_s.licence").alias("licence"))).alias("_n"))
    nearest = stage(nearest.select(F.col("dir").alias("_dir"), F.col("_n.above").alias("from_dir"),
                                   F.col("_n.licence").alias("inherited")), "nearest")
    both = named.join(nearest, named["dir"] == nearest["_dir"], "left")
    return both.select(
        "doc_id", "path", F.col("licence").alias("own"), "similarity", "inherited", "from_dir",
        F.coalesce("licence", "inherited").alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("basis"))
