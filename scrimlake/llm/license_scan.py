"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance down the directories.

Headers of a file are the sentences with a cue word of its lines, and those of a line with a cue together with the line
before and after it, so that wrapped notices and statements inside a paragraph count. A licence file, by its name, has
its whole text as one more. Equal headers of a file count once. Headers are vectors of words and word
pairs; idf comes from the headers of all files and the wordings of the templates. Only terms that a wording has can add
to a cosine, so headers are joined with the wordings' terms, whose number is fixed here, on the term. A file's license
is that of the wording closest to one of its headers, if close enough. A file without one has the license of the nearest
directory above it that holds a licence file: directories are joined with the directories above them, and files with
their own directory.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch, ascii_lower

# fixed values: the wording of public licenses
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR '
    "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with this program."
)
#: License identifiers and wordings that mark them: short statements, notices of source files, whole texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy."),
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3. It is free software."),
    ("GPL-3.0", _GNU.replace("{0} ", "")),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero")),
    ("BSD-2-Clause", f"{_REDISTRIBUTION} {_DISCLAIMER}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD License."),
    ("BSD-3-Clause", f"{_REDISTRIBUTION} {_ENDORSEMENT} {_DISCLAIMER}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, the Creative Commons Attribution license."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0, the Creative Commons NonCommercial license."),
    ("Proprietary", "All rights reserved. Copyright. No part may be reproduced without permission."),
)
CUE = r"(?i)licen[cs]e|copyright|rights reserved|spdx|hereby granted|redistribution"
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
SENTENCE_END = r"(?<=[.!?])\s(?=[A-Z])"
THRESHOLD = 0.35


def _term_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, repeats included."""
    return F.filter(F.split(ascii_lower(text), r"[^a-z0-9]+"), lambda x: x != "")


def _vectors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): how often each term occurs."""
    w = df.select(key, _term_words(F.col(text)).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    return w.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _one_line(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def headers_of(files: DataFrame, licence_name: str = LICENCE_NAME) -> DataFrame:
    """(path, header): what of each file is held against the wordings, equal headers of a file once."""
    named = F.coalesce(F.col("path").rlike(licence_name), F.lit(False))
    lines = F.split("text", "\n", -1)
    rest = F.size(lines) - 1
    around = F.arrays_zip(F.concat(F.array(F.lit("")), F.slice(lines, 1, rest)), lines, F.concat(F.slice(lines, 2, rest), F.array(F.lit(""))))

    def of_line(z: Column) -> Column:
        near = F.concat_ws(" ", z["0"], z["1"], z["2"])
        sentences = F.flatten(F.transform(F.array(z["1"], near), lambda x: F.split(_one_line(x), SENTENCE_END)))
        return F.filter(sentences, lambda x: x.rlike(CUE))

    found = F.flatten(F.transform(F.filter(around, lambda z: z["1"].rlike(CUE)), of_line))
    whole = F.when(named, F.array(_one_line(F.col("text")))).otherwise(F.array().cast("array<string>"))
    rows = files.where(F.col("text").rlike(CUE) | (named & F.col("text").isNotNull()))
    return rows.select("path", F.explode(F.array_distinct(F.concat(found, whole))).alias("header")).where("header != ''")


def own_licenses(files: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, licence_name: str = LICENCE_NAME) -> DataFrame:
    """(path, license, similarity) of the files with a header close enough to a wording. files: path, text."""
    spark = files.sparkSession
    lines = scratch.save(headers_of(files, licence_name).withColumn("key", F.unhex(F.md5("header"))), "lines")
    headers = scratch.save(lines.groupBy("key", "header").agg(F.count(F.lit(1)).alias("n")), "headers")  # equal headers are one, counted n times
    vectors = scratch.save(_vectors(headers, "key", "header"), "vectors")
    headers = headers.select("key", "n")
    templates = spark.createDataFrame([(k, *t) for k, t in enumerate(TEMPLATES)], "template int, license string, wording string")
    wording = _vectors(templates.select("template", "wording"), "template", "wording")
    total = headers.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + len(TEMPLATES)
    seen = vectors.join(headers, "key").groupBy("term").agg(F.sum("n").alias("n")).unionByName(wording.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    idf = seen.groupBy("term").agg(F.sum("n").alias("df")).select("term", (F.log((1.0 + total) / (1 + F.col("df"))) + 1).alias("idf"))
    weigh = lambda v: v.join(idf, "term").withColumn("x", F.col("tf") * F.col("idf"))
    h, t = weigh(vectors), weigh(wording)
    norm = lambda v, key: v.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias(f"{key}_norm"))
    t = t.select("template", "term", F.col("x").alias("y")).join(norm(t, "template"), "template").join(templates.select("template", "license"), "template")
    t = F.broadcast(t)  # the wordings' terms, some 1500 rows
    dots = h.join(t, "term").groupBy("key", "template", "license", "template_norm").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    close = dots.join(norm(h, "key"), "key").select("key", "license", F.round(F.col("dot") / (F.col("key_norm") * F.col("template_norm")), 6).alias("similarity"))
    close = close.where(F.col("similarity") >= threshold)
    best = close.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    found = lines.join(best, "key").groupBy("path").agg(F.min("b").alias("b"))
    return found.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("similarity"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", licence_name: str = LICENCE_NAME, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, similarity, origin (own, inherited or none) and from_folder of every row of files.

    Null and empty texts have no license of their own. Null paths are in no folder and have no license. Of wordings
    equally close the identifier that sorts first counts; of several licence files in a folder the closest, then that identifier. Repeated paths share what any
    of their rows has; each row comes back. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(files.sparkSession, "licenses")
    rows = files.select(F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = scratch.save(own_licenses(rows, scratch, threshold, licence_name), "own")
    granted = own.where(F.col("path").rlike(licence_name)).groupBy(_folder(F.col("path")).alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "license")).alias("b"))
    granted = scratch.save(granted.select("above", F.col("b.license").alias("theirs")), "granted")
    folders = rows.select(_folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.array_distinct(F.concat(F.array(F.lit("")), above))  # the root of relative paths
    nearest = folders.where(F.col("folder").isNotNull()).select("folder", F.explode(above).alias("above")).join(granted, "above").groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "theirs")).alias("g"))
    nearest = scratch.save(nearest.select("folder", F.col("g.above").alias("from_folder"), "g.theirs"), "nearest")
    out = rows.select("path", _folder(F.col("path")).alias("folder")).join(own, "path", "left").join(nearest, "folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path", F.coalesce("license", "theirs").alias("license"), "similarity",
        F.when(mine, "own").when(F.col("theirs").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~mine, F.col("from_folder")).alias("from_folder"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """documents as files: a folder for each source, in it one for each hundred thousand ids, in it one for each
    hundred; a text is a licence file if at least a twentieth of its lines have a cue. A null source is "unknown", a null
    text is empty, a null doc_id gives a null path; repeated rows share a path."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    name = F.when(F.size(F.filter(lines, lambda x: x.rlike(CUE))) * 20 >= F.size(lines), "LICENSE-").otherwise("text-")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("part-"), F.expr("doc_id div 100000")), F.concat(F.lit("set-"), F.expr("doc_id div 100")), F.concat(name, F.col("doc_id")))
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
