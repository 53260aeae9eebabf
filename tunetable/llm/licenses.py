"""License scan: sparse TF-IDF cosine of lines to notice templates, then inheritance from the nearest directory.

Only terms of the templates have weights of their own, so a line is a sparse
vector over a small fixed vocabulary plus the number of its other terms. The
inverse frequency of every vocabulary term is counted over all lines of all
files; a term outside the vocabulary weighs as one that no line has. A line is
a notice if its cosine with a template reaches ``COSINE``; a file's own
license is that of its best notice.

A license file is one whose notices hold at least ``FILE_SHARE`` of its terms,
or whose name says so (LICENSE, COPYING, NOTICE). The license of a directory is
the one that most of its license files state. A file without its own license
inherits that of the nearest ancestor directory that has one: distinct
directories are joined with their ancestors, then files with their directory.

All of it is DataFrame work; a line is scored inside its row, and no text is
shuffled.

Defined cases: null and empty texts have no notice and may inherit; a null
path has no directory and inherits nothing; equal scores go to the license
first by name; repeated rows get equal results; an empty table gives an empty
table; other columns pass if asked for.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# The usual one-line notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is licensed under the Apache License, Version 2.0 (the License)"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
COSINE, FILE_SHARE = 0.8, 0.5
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[^/]*)?$"


def _terms(text: str) -> list[str]:
    return sorted(set(re.findall(TERM, text.lower())))


def template_terms(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(name, _terms(t)) for name, ts in sorted(templates.items()) for t in ts]


def line_terms(text: Column) -> Column:
    """Per line the distinct terms; lines without a term are left out."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    terms = F.transform(lines, lambda x: F.array_distinct(F.regexp_extract_all(ascii_lower(x), F.lit(TERM), F.lit(0))))
    return F.filter(terms, lambda d: F.size(d) > 0)


def _words(ws: list[str]) -> Column:
    return F.array(*map(F.lit, ws))


def weights(files: DataFrame, vocabulary: list[str], text_col: str) -> tuple[dict[str, float], float]:
    """Squared inverse line frequencies of the vocabulary, and that of any other term, over all lines."""
    lines = files.select(F.explode(line_terms(F.col(text_col))).alias("d"))
    known = lines.select(F.explode(F.concat(F.array_intersect("d", _words(vocabulary)), F.array(F.lit("")))).alias("term"))  # '' counts lines
    found = {r[0]: r[1] for r in known.groupBy("term").count().collect()}  # a row per vocabulary term at most
    n = found.get("", 0)

    def squared(df: int) -> float:
        return (math.log((1 + n) / (1 + df)) + 1) ** 2

    return {t: squared(found.get(t, 0)) for t in vocabulary}, squared(0)


def scan(files: DataFrame, path: Column, text_col: str = "text", keep: tuple[str, ...] = (), templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per row: the columns ``keep``, ``path, own_license, score, n_notices, is_license_file, inherited_license, inherited_from, license``."""
    all_terms = template_terms(templates)
    vocabulary = sorted({t for _, ts in all_terms for t in ts})
    weight, other = weights(files, vocabulary, text_col)
    table = F.create_map(*(F.lit(x) for kv in weight.items() for x in kv))

    def total(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.element_at(table, t))

    def scored(d: Column) -> Column:
        known = F.array_intersect(d, _words(vocabulary))
        length = total(known) + (F.size(d) - F.size(known)) * F.lit(other)
        best = []
        for name, ts in all_terms:
            norm = math.sqrt(sum(weight[t] for t in ts))
            best.append(F.struct(F.round(total(F.array_intersect(d, _words(ts))) / (F.sqrt(length) * F.lit(norm)), 6).alias("score"), F.lit(name).alias("name")))
        top = F.array_max(F.transform(F.array(*best), lambda b: b["score"]))
        return F.struct(top.alias("score"), F.array_min(F.transform(F.filter(F.array(*best), lambda b: b["score"] == top), lambda b: b["name"])).alias("name"), F.size(d).alias("terms"))

    def possible(d: Column) -> Column:
        """A cosine is at most the share of a line's length that lies in the vocabulary."""
        known = F.array_intersect(d, _words(vocabulary))
        inner = total(known)
        return inner >= F.lit((COSINE - 0.001) ** 2) * (inner + (F.size(d) - F.size(known)) * F.lit(other))

    rows = files.select(*keep, path.alias("path"), line_terms(F.col(text_col)).alias("__terms"))
    rows = rows.select(*keep, "path", F.aggregate("__terms", F.lit(0), lambda acc, d: acc + F.size(d)).alias("__n"),
                       F.filter(F.transform(F.filter("__terms", possible), scored), lambda s: s["score"] >= COSINE).alias("__notices"))
    top = F.array_max(F.transform("__notices", lambda s: s["score"]))
    own = F.array_min(F.transform(F.filter("__notices", lambda s: s["score"] == top), lambda s: s["name"]))
    share = F.aggregate("__notices", F.lit(0), lambda acc, s: acc + s["terms"]) >= F.lit(FILE_SHARE) * F.col("__n")
    rows = rows.select(*keep, "path", own.alias("own_license"), top.alias("score"), F.size("__notices").alias("n_notices"),
                       (own.isNotNull() & (share | F.coalesce(F.col("path").rlike(_FILE), F.lit(False)))).alias("is_license_file"))
    rows = stored(rows.withColumn("__dir", F.regexp_replace("path", r"/?[^/]*$", "")), "license-rows")  # without texts; read three times below

    stated = rows.filter("is_license_file AND path IS NOT NULL").groupBy("__dir", "own_license").agg(F.count("*").alias("n"))
    of_dir = stated.groupBy("__dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "own_license"))["own_license"].alias("inherited_license"))
    nearest = inherited(rows.select("__dir").filter("__dir IS NOT NULL").distinct(), of_dir)
    out = rows.join(nearest, "__dir", "left")
    return out.select(*keep, "path", "own_license", "score", "n_notices", "is_license_file", "inherited_license", "inherited_from", F.coalesce("own_license", "inherited_license").alias("license"))


def inherited(dirs: DataFrame, of_dir: DataFrame) -> DataFrame:
    """``(__dir, inherited_license, inherited_from)`` of directories with a license in them or above."""
    parts = F.split("__dir", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("__dir") == "", 0).otherwise(F.size(parts)))
    above = dirs.select("__dir", F.explode(F.transform(depths, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above")).distinct()
    known = of_dir.withColumnRenamed("__dir", "above")
    found = above.join(known, "above").groupBy("__dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "inherited_license")).alias("m"))
    return found.select("__dir", F.col("m.inherited_license").alias("inherited_license"), F.col("m.above").alias("inherited_from"))
