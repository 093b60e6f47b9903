"""Licence scan: notices in files by TF-IDF cosine to templates, then inheritance by directory.

Every line of a file is a sparse vector of term weights and is compared with the
vector of every template. A term's weight is its count times its inverse document
frequency, counted over all files for the templates' terms; terms that no template
has count as found nowhere, so longer lines match less. A line that reaches the
threshold must hold one of the templates' leading terms (prefix filtering: the other
terms together are too light), so only such lines are taken apart.

Headers and licence texts of several lines (``license_texts``) are compared the same
way, with a vocabulary of their own, to runs of as many words from the start of each
line. Only files that hold enough of a text's weight for the threshold are taken apart.

A file in which notices make up much of the text is a licence file and licenses its
directory. A file without a notice inherits from its nearest ancestor directory that
has a licence.

Only DataFrame operations: no Python code runs on the rows.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

MIN_COSINE = 0.7
FILE_SHARE = 0.1  # of a licence file's words are in its notice, at least
_LINES = 256  # of a file are taken apart in one row

# Common licence notices, one line each.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-Clause license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

def _bags(templates) -> dict[str, list[str]]:
    return {name: [t for t in re.split("[^a-z0-9]+", text.lower()) if t] for name, text in templates}


def weigh(bags: dict[str, list[str]], idf: dict[str, float]) -> tuple[list[tuple[str, str, float]], list[str]]:
    """``(license, term, weight)`` rows, of unit length for each template, and the leading terms."""
    rows, leading = [], set()
    for name, bag in bags.items():
        weight = {t: bag.count(t) * idf[t] for t in bag}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        rows += [(name, t, w / norm) for t, w in sorted(weight.items())]
        rest = 1.0
        for t in sorted(weight, key=lambda t: (-idf[t], t)):  # rarest first
            if math.sqrt(max(0.0, rest)) < MIN_COSINE - 1e-6:
                break  # the terms left over cannot reach the threshold by themselves
            leading.add(t)
            rest -= (weight[t] / norm) ** 2
    return rows, sorted(leading)


def _words(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _literal(spark, schema: str, rows) -> DataFrame:
    """A small table as one value of the plan."""
    fields = [f.split()[0] for f in schema.split(", ")]
    text = json.dumps([dict(zip(fields, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def _terms(terms):
    return F.split(F.lit(" ".join(terms)), " ")


def text_notices(files: DataFrame, spread: dict[str, int], unknown: float) -> DataFrame:
    """``path, license, line, score, share`` of the runs of words that match a text of ``TEXTS``.

    ``spread`` has the files of each term. ``share`` is 1 for a text that only a
    licence file holds.
    """
    bags = {str(k): _bags([("", text)])[""] for k, (_, text, _) in enumerate(TEXTS)}
    idf = {t: unknown - math.log(1 + spread.get(t, 0)) for bag in bags.values() for t in bag}
    rows, leading = weigh(bags, idf)
    spark = files.sparkSession
    known = F.broadcast(_literal(spark, "text_id string, term string, weight double", rows))
    rarity = F.broadcast(_literal(spark, "term string, idf double", sorted(idf.items())))
    kinds = F.broadcast(_literal(spark, "text_id string, license string, whole boolean, length int",
                                 [(str(k), name, whole, len(bags[str(k)])) for k, (name, _, whole) in enumerate(TEXTS)]))
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    hit = files.where(F.col("path").isNotNull() & F.arrays_overlap(words, _terms(leading)))
    hit = hit.select("path", F.xxhash64("text").alias("copy"), "text")
    file = ["path", "copy"]
    # No run's cosine is more than the root of the squared weights of the terms in its file.
    held = hit.select(*file, F.explode(F.array_distinct(words)).alias("term")).distinct().join(known, "term")
    held = held.groupBy(*file, "text_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("most"))
    held = held.where(F.col("most") >= MIN_COSINE ** 2 - 1e-6).join(kinds, "text_id").drop("most")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("w"))), lambda x: F.size(x["w"]) > 0)
    whole = hit.dropDuplicates(file).join(held, file).select(
        *file, "text_id", "license", "whole", "length", F.size(_words("text")).alias("words"), lines.alias("lines"))
    # A line holds a word at least, so a run ends within as many lines as it has words.
    parts = whole.select(*file, "text_id", "license", "whole", "length", "words", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("lines"), F.lit(_LINES)), lambda at: F.slice("lines", at, F.lit(_LINES) + F.col("length")))).alias("part"))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.lit(_LINES), F.size("part"))), lambda i: F.struct(
        F.get("part", i - 1)["line"].alias("line"),
        F.slice(F.flatten(F.transform(F.slice("part", i, F.col("length")), lambda x: x["w"])), F.lit(1), F.col("length")).alias("w")))
    key = [*file, "text_id", "license", "whole", "words", "line"]
    terms = parts.select(*key[:-1], F.explode(runs).alias("r")).select(*key[:-1], "r.line", F.explode("r.w").alias("term"))
    terms = terms.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n")).join(rarity, "term", "left").join(known, ["text_id", "term"], "left")
    w = F.col("n") * F.coalesce("idf", F.lit(unknown))
    cosine = F.sum(w * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(w * w))
    found = terms.groupBy(*key).agg(F.round(cosine, 6).alias("score"), F.sum("n").alias("own"))
    return found.where(F.col("score") >= MIN_COSINE).select(
        "path", "license", "line", "score", F.when(F.col("whole"), 1.0).otherwise(F.round(F.col("own") / F.col("words"), 6)).alias("share"))


def notices(files: DataFrame, templates=None) -> DataFrame:
    """``path, license, score, share``: the best notice of each file that has one.

    ``score`` is the cosine, ``share`` the part of the file's words in the notice, which
    is a line or, with the templates of this module, a text of several lines.
    Ties go to the first line, then to the first licence by name. Null paths and null
    texts have no notice; texts that repeat a path are one file.
    """
    bags = _bags(TEMPLATES if templates is None else templates)
    vocabulary = sorted({t for bag in bags.values() for t in bag})
    spark, texts = files.sparkSession, files.where(F.col("text").isNotNull())
    counted = {*vocabulary}
    if templates is None:
        counted |= {t for _, text, _ in TEXTS for t in _bags([("", text)])[""]}
    own = F.explode(F.array_intersect(F.split(F.lower("text"), "[^a-z0-9]+"), _terms(sorted(counted))))
    # One row for each term of a template.
    spread = {r["term"]: r["n"] for r in texts.select(own.alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    unknown = math.log(1 + texts.count()) + 1
    idf = {t: unknown - math.log(1 + spread.get(t, 0)) for t in vocabulary}
    rows, leading = weigh(bags, idf)
    known = _literal(spark, "license string, term string, weight double, idf double", [(*r, idf[r[1]]) for r in rows])
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(leading) + ")(?![a-z0-9])"
    hit = files.where(F.col("path").isNotNull() & F.col("text").rlike(pattern)).select("path", "text")
    lines = hit.select("path", F.size(_words("text")).alias("words"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    terms = lines.where(F.col("content").rlike(pattern)).select("path", "words", "line", F.explode(_words("content")).alias("term"))
    terms = terms.groupBy("path", "words", "line", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = terms.join(F.broadcast(known.select("term", "idf").distinct()), "term", "left")  # the templates' terms
    weighed = weighed.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    key = ["path", "words", "line"]
    norms = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("n").alias("own"))
    dots = weighed.join(F.broadcast(known.select("license", "term", "weight")), "term").groupBy(*key, "license").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, key).select("path", "license", "line", F.round(F.col("dot") / F.col("norm"), 6).alias("score"),
                                          F.round(F.col("own") / F.col("words"), 6).alias("share"))
    if templates is None:
        scored = scored.unionByName(text_notices(texts.select("path", "text"), spread, unknown))
    best = F.min_by(F.struct("license", "score", "share"), F.struct(-F.col("score"), "line", "license")).alias("b")
    return scored.where(F.col("score") >= MIN_COSINE).groupBy("path").agg(best).select("path", "b.license", "b.score", "b.share")


def directory(path):
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, templates=None) -> DataFrame:
    """``path, own_license, score, license, inherited_from`` of every row of ``files`` (path, text).

    ``own_license`` and ``score`` are null without a notice. ``license`` is the own
    one, else that of the nearest ancestor directory with a licence file, whose
    path ``inherited_from`` then gives; several such files in one directory: the
    best score, then the first path. The root directory is the empty path. Rows
    that repeat a path repeat the answer; a null path has no licence.
    """
    found = notices(files.select("path", "text"), templates)
    dirs = found.where((F.col("share") >= FILE_SHARE) | F.lower(F.regexp_extract("path", "([^/]*)$", 1)).rlike("^(licen[sc]e|copying)"))
    dirs = dirs.withColumn("dir", directory("path")).groupBy("dir").agg(
        F.min_by("license", F.struct(-F.col("score"), "path")).alias("dir_license"))
    # Directories are few beside files: the ancestors of each directory are met once.
    places = files.where("path IS NOT NULL").select(directory("path").alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    above = places.select(F.col("dir").alias("place"), F.explode(up).alias("u")).select("place", "u.depth", F.col("u.above").alias("dir")).distinct()
    nearest = above.join(dirs, "dir").groupBy("place").agg(
        F.max_by(F.struct("dir", "dir_license"), "depth").alias("near")).select("place", "near.dir", "near.dir_license")
    out = files.select("path").withColumn("place", directory("path"))
    out = out.join(found.select("path", F.col("license").alias("own_license"), "score"), "path", "left").join(nearest, "place", "left")
    return out.select("path", "own_license", "score", F.coalesce("own_license", "dir_license").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("dir")).alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/<doc_id div 10000>/<doc_id div 1000>/<doc_id>.txt``.

    Rows without doc_id are the file ``source/none.txt``; a null source is left out of the path."""
    up = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return docs.select("doc_id", F.concat_ws("/", "source", up(10000), up(1000), name).alias("path"), "text")


def op6_license_scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` beside the columns of :func:`license_scan`, for the documents as files.

    Rows that repeat a path (a source and a doc_id, null or not) are one file."""
    found = license_scan(document_files(docs))
    name = F.regexp_extract("path", "(-?[0-9]+)[.]txt$", 1).try_cast("bigint")
    return found.select(name.alias("doc_id"), "path", "own_license", "score", "license", "inherited_from")


def op6_sql() -> str:
    values = ", ".join(f"('{name}', '{t}', {bag.count(t)})" for name, bag in _bags(TEMPLATES).items() for t in sorted(set(bag)))
    words = "[t FOR t IN regexp_split_to_array(lower({0}), '[^a-z0-9]+') IF t <> '']"
    return f"""
WITH c(license, term, n) AS (VALUES {values}),
df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest({words.format('text')}) AS term FROM documents) GROUP BY term),
u AS (SELECT ln(1 + count(text)) + 1 AS unknown FROM documents),
i AS (SELECT DISTINCT c.term, u.unknown - ln(1 + coalesce(df.n, 0)) AS idf FROM c CROSS JOIN u LEFT JOIN df USING (term)),
k AS (SELECT license, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY license)) AS weight FROM c JOIN i USING (term)),
f AS (SELECT doc_id, source || '/' || (doc_id // 10000) || '/' || (doc_id // 1000) || '/' || doc_id || '.txt' AS path, text FROM documents),
l AS (SELECT path, len({words.format('text')}) AS words, unnest(string_split(text, chr(10))) AS content,
             generate_subscripts(string_split(text, chr(10)), 1) AS line FROM f),
t AS (SELECT path, words, line, term, count(*) AS n FROM
      (SELECT path, words, line, unnest({words.format('content')}) AS term FROM l) GROUP BY ALL),
w AS (SELECT t.*, t.n * coalesce(i.idf, u.unknown) AS w FROM t CROSS JOIN u LEFT JOIN i USING (term)),
n AS (SELECT path, words, line, sqrt(sum(w * w)) AS norm, sum(n) AS own FROM w GROUP BY ALL),
d AS (SELECT path, words, line, license, sum(w * weight) AS dot FROM w JOIN k USING (term) GROUP BY ALL),
s AS (SELECT path, license, line, round(dot / norm, 6) AS score, round(own / words, 6) AS share FROM d JOIN n USING (path, words, line)),
b AS (SELECT * FROM s WHERE score >= {MIN_COSINE} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, line, license) = 1),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license AS dir_license FROM b WHERE share >= {FILE_SHARE}
         QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) = 1),
x AS (SELECT path, dir, dir_license FROM f JOIN dirs ON dir = '' OR starts_with(path, dir || '/')
      QUALIFY row_number() OVER (PARTITION BY path ORDER BY len(dir) DESC) = 1)
SELECT f.doc_id, f.path, b.license AS own_license, b.score, coalesce(b.license, x.dir_license) AS license,
       CASE WHEN b.license IS NULL THEN x.dir END AS inherited_from
FROM f LEFT JOIN b USING (path) LEFT JOIN x USING (path)
"""
