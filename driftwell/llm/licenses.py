"""License scans, in DataFrame expressions only: lines, paragraphs and whole texts against templates by TF-IDF cosine, then the
license of the nearest ancestor directory for files that declare none.

Terms are lower-cased runs of letters and digits, and idf(term) = ln((N + 1) / (df + 1)) + 1 over all documents. A vector has tf * idf
of a piece's terms. ``headers`` and ``texts`` (notices and short licenses, each as a whole) are compared with lines, paragraphs (lines
between those without a letter or digit) and two and three paragraphs in a row; they and ``wholes``, the texts of whole licenses, with whole files.

Few pieces have to be compared:

- a piece whose cosine with a template reaches a threshold shares one of the template's rarest terms, as many as leave the
  rest of its weight under the threshold; texts and pieces without such a term are dropped unseen;
- idf is 1 at least, so a piece's length is at least that of its plain counts, which bounds its cosine from above; the
  document frequencies of other terms are then counted for those of the pieces that can still reach the threshold, by a join.

Both tests are exact. Texts are dealt out once, by their hash, and all of the second test runs where they lie: a piece is summed up
against all templates in one pass, and only what can reach its threshold is moved again.

A file whose whole text reaches ``file_threshold`` with a license, and exceeds that with any other by ``margin``, is a license file: it
speaks for its directory and all below it that have none nearer, and for itself if the license is one of ``wholes``. Any other file
declares the license of its best line or run of paragraphs, if that reaches ``threshold``. Of several license files of a directory the
best speaks, the least license name and path breaking ties.

Published licenses of different names are at 0.88 of each other at most (versions of one at 0.96, which ``margin`` is for: list them all).

Null and empty texts declare nothing. A null path is in no directory, and inherits nothing.
"""

from __future__ import annotations

import math
from importlib.resources import files as packaged

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import held, saved

#: Short declarations and notices of well-known licenses; a parameter of the scan.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
#: Short licenses, and the notices that files carry, of some paragraphs; a parameter of the scan.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.""",
}
#: Whole licenses in the folder ``license_texts``, word for word as they are published.
WHOLES = ("Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


def whole_licenses() -> dict[str, str]:
    """The texts of ``WHOLES``."""
    folder = packaged("driftwell.llm") / "license_texts"
    return {k: (folder / f"{k}.txt").read_text("utf-8") for k in WHOLES}


def terms(text: Column) -> Column:
    """The terms of a text, in order."""
    cut = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, " "))


def _terms(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those with each term of the (fixed) vocabulary."""
    known = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in ["", *vocabulary]], "term string"))
    rows = docs.select(F.explode(F.concat(F.array_distinct(terms(F.col(text))), F.array(F.lit("")))).alias("term")).join(known, "term", "left_semi").groupBy("term").count().collect()
    found = {r["term"]: r["count"] for r in rows}
    return found.pop("", 0), found


class Model:
    """Unit template vectors and the idf of their terms; templates are (license, text)."""

    def __init__(self, templates: list[tuple[str, str]], n: int, df: dict[str, int]):
        self.n = n
        self.idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, text in templates for t in _terms(text)}
        self.vectors = {}
        for k, (license, text) in enumerate(templates):
            words = _terms(text)
            v = {t: words.count(t) * self.idf[t] for t in words}
            size = math.sqrt(sum(x * x for x in v.values()))
            self.vectors[license, k] = {t: x / size for t, x in v.items()}

    def prefix(self, threshold: float, first: int | None = None) -> list[str]:
        """Terms of which a text within ``threshold`` of one of the (first) templates has one at least."""
        out: set[str] = set()
        for v in list(self.vectors.values())[:first]:
            heavy = sorted(v, key=lambda t: (-self.idf[t], t))  # rare terms first: any order is exact, and this one drops most texts
            rest = sum(x * x for x in v.values())
            for t in heavy:
                if rest < threshold * threshold - 1e-12:
                    break
                out.add(t)
                rest -= v[t] * v[t]
        return sorted(out)


    def table(self, spark) -> DataFrame:
        """(term, idf, w) of the templates' terms, with a weight a template: as many rows as templates have terms."""
        vectors = list(self.vectors.values())
        return F.broadcast(spark.createDataFrame([(t, x, [v.get(t, 0.0) for v in vectors]) for t, x in sorted(self.idf.items())], "term string, idf double, w array<double>"))

    def dots(self, x: Column) -> list[Column]:
        """For each template, the sum of ``x`` times its weight."""
        return [F.coalesce(F.sum(x * F.col("w")[k]), F.lit(0.0)).alias(f"_d{k}") for k in range(len(self.vectors))]


def _most(model: Model, first: int) -> tuple[Column, Column]:
    """The largest of the dots with the first templates, and with all."""
    of = lambda n: F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"_d{k}") for k in range(n)))
    return of(first), of(len(model.vectors))


def _reaching(pieces: Column, wholes: Column, threshold: float, file_threshold: float) -> Column:
    return F.when(F.col("line") == 0, wholes >= (file_threshold - 1e-9) * F.col("size")).otherwise(pieces >= (threshold - 1e-9) * F.col("size"))


def reachable(pieces: DataFrame, model: Model, first: int, threshold: float, file_threshold: float) -> DataFrame:
    """(t, line, terms) of the pieces (t, line, words), dealt out by t, whose cosine with a template can still reach its threshold; line 0 is a whole text, and others meet the first templates only."""
    tf = pieces.select("t", "line", F.explode("words").alias("term")).groupBy("t", "line", "term").agg(F.count("*").alias("tf")).join(model.table(pieces.sparkSession), "term", "left")
    least = F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(1.0)), 2)))
    said = F.collect_list(F.struct("term", "tf", "idf")).alias("terms")
    sums = tf.groupBy("t", "line").agg(least.alias("size"), said, *model.dots(F.col("tf") * F.col("idf")))
    return saved(sums.where(_reaching(*_most(model, first), threshold, file_threshold)).select("t", "line", "terms"))


def other_idf(docs: DataFrame, text: str, found: DataFrame, n: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(term, other) of the terms in ``found`` that have no idf yet, by their documents; they are broadcast to the texts if they are so few, and meet them in a shuffle else."""
    missing = saved(found.select(F.explode("terms").alias("x")).where("x.idf is null").select("x.term").distinct())
    few = missing.count() <= broadcast_rows
    terms_of = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term"))
    df = terms_of.join(F.broadcast(missing) if few else missing, "term", "left_semi").groupBy("term").count()
    return saved(df.select("term", (F.log((n + 1) / (F.col("count") + 1)) + 1).alias("other")))


def compared(found: DataFrame, other: DataFrame, model: Model, first: int) -> DataFrame:
    """(t, line, score, license, template, gap) of the best template of each piece; gap is how far it is ahead of the best one of another license."""
    x = F.col("tf") * F.coalesce("idf", "other", F.lit(math.log((model.n + 1) / 1) + 1))
    tf = found.select("t", "line", F.explode("terms").alias("x")).select("t", "line", "x.*").join(other, "term", "left").withColumn("x", x)
    tf = tf.join(model.table(found.sparkSession).select("term", "w"), "term", "left")
    sums = tf.groupBy("t", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"), *model.dots(F.col("x")))
    every = [F.struct((-F.round(F.col(f"_d{k}") / F.col("size"), 9)).alias("s"), F.lit(license).alias("license"), F.lit(k).alias("template")) for license, k in model.vectors]
    if not every:
        return found.select("t", "line", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("int").alias("template"), F.lit(None).cast("double").alias("gap")).limit(0)
    ranked = F.array_sort(F.when(F.col("line") == 0, F.array(*every)).otherwise(F.array(*every[:first])))
    best = sums.select("t", "line", F.explode(F.array(ranked)).alias("z")).select("t", "line", F.col("z")[0].alias("best"), F.get(F.filter("z", lambda a: a["license"] != F.col("z")[0]["license"]), F.lit(0)).alias("next"))
    return best.select("t", "line", (-F.col("best.s")).alias("score"), "best.license", "best.template", (F.coalesce("next.s", F.lit(0.0)) - F.col("best.s")).alias("gap"))


def ancestors(directory: str) -> Column:
    """A directory and all above it, deepest first; the root is ''."""
    parts = F.split(F.regexp_replace(directory, "/+$", ""), "/")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def _runs(paragraphs: Column) -> Column:
    """Two, and three, paragraphs in a row."""
    after = lambda of, k: F.filter(F.zip_with(of, F.slice(paragraphs, k, F.greatest(F.size(paragraphs), F.lit(1))), lambda a, b: F.concat(a, F.lit("\n"), b)), lambda x: x.isNotNull())
    return F.concat(after(paragraphs, 2), after(after(paragraphs, 2), 3))


def scanned(
    docs: DataFrame, id: str = "doc_id", text: str = "text", path: str = "path", headers: dict[str, str] | None = None, texts: dict[str, str] | None = None, wholes: dict[str, str] | None = None,
    threshold: float = 0.6, file_threshold: float = 0.9, margin: float = 0.03,
) -> DataFrame:
    """One row of each row of ``docs``: id, path, license, score, origin ('text' of a whole license, 'header', 'directory' or 'none') and n_headers, the lines and paragraphs that declare a license.

    Without ``wholes``, those of ``whole_licenses`` are taken, unless ``texts`` are given.
    """
    wholes = (whole_licenses() if texts is None else {}) if wholes is None else wholes
    headers, texts = TEMPLATES if headers is None else headers, TEXTS if texts is None else texts
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.col(path).cast("string").alias("path"))
    every, first = [*headers.items(), *texts.items(), *wholes.items()], len(headers) + len(texts)
    n, df = document_frequencies(rows, "text", sorted({t for _, x in every for t in _terms(x)}))
    model = Model(every, n, df)
    of_pieces, of_files = model.prefix(threshold, first), model.prefix(file_threshold)
    array = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    # a text's hash names it: copies are compared once, and ids may be null or repeated
    rows = rows.withColumn("t", F.sha2(F.coalesce("text", F.lit("")), 256))
    worth = held(rows.select("t", "text").withColumns({"words": terms(F.col("text"))}), "words").where(F.arrays_overlap("words", array(sorted({*of_pieces, *of_files})))).select("t", "text")
    worth = worth.dropDuplicates(["t"])  # one pass over all texts; few stay, dealt out by t
    worth = held(worth.withColumn("paras", F.split("text", r"\n[^\p{L}\p{N}\n]*\n")), "paras")
    several = F.filter("paras", lambda x: F.instr(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), "\n") > 0)
    pieces = worth.select("t", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"), several, _runs(F.col("paras")))).alias("line", "said"))
    telling = F.when(F.col("line") == 0, F.arrays_overlap("words", array(of_files))).otherwise(F.arrays_overlap("words", array(of_pieces)))
    pieces = held(pieces.withColumn("words", terms(F.col("said"))).drop("said"), "words").where(telling)
    near = reachable(pieces, model, first, threshold, file_threshold)
    found = saved(compared(near, other_idf(rows, "text", near, n), model, first).where(F.col("score") >= F.when(F.col("line") == 0, file_threshold).otherwise(threshold)))
    top = found.where("line > 0").groupBy("t").agg(F.count("*").alias("n_headers"), F.min(F.struct((-F.col("score")).alias("s"), "license", "line")).alias("best"))
    files = found.where((F.col("line") == 0) & (F.col("gap") >= margin))
    slim = rows.select("id", "path", "t").withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    mine = slim.join(top, "t", "left").join(files.where(F.col("template") >= first).select("t", F.struct("score", "license").alias("whole")), "t", "left")
    spoken = slim.where("dir is not null").join(files.select("t", "score", "license"), "t")
    spoken = spoken.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("file"))
    dirs = slim.select("dir").where("dir is not null").distinct()
    above = dirs.select("dir", F.posexplode(ancestors("dir")).alias("up", "at"))
    nearest = above.join(spoken.select(F.col("dir").alias("at"), "file"), "at").groupBy("dir").agg(F.min(F.struct("up", "file")).alias("near"))
    out = mine.join(nearest, "dir", "left")
    whole, own = F.col("whole").isNotNull(), F.col("best").isNotNull()
    return out.select(
        F.col("id").alias(id), F.col("path").alias(path),
        F.when(whole, F.col("whole.license")).when(own, F.col("best.license")).otherwise(F.col("near.file.license")).alias("license"),
        F.round(F.when(whole, F.col("whole.score")).when(own, -F.col("best.s")).otherwise(-F.col("near.file.s")), 6).alias("score"),
        F.when(whole, "text").when(own, "header").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"),
    )
