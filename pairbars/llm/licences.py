"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance by path.

Lines of a text that speak of a licence are its headers. Their words are joined to
the words of the templates, which have weights by how few templates use them; a
word of no template weighs like one of a single template. The cosine of each header
to each template is a sum over the join. Every text is also read by the identifier
of an SPDX tag and as a whole against full licence texts of about its length, which
go before its lines. A text of which no line is over the threshold, or only one that
reserves all rights, is read by windows of words about each mention of a licence, as
long as the passage they are compared with and over line ends. Then every directory takes the licence of its licence file, and a file without a header
that of its nearest ancestor directory that has one, by joins on the paths of the
distinct directories.

The templates are few and fixed by the caller, and their words are broadcast up to
``BROADCAST_ROWS``. All is in DataFrame functions.

Edge cases: null and empty texts have no header; a null path is a file at the top;
of templates with equal cosine the first by name counts, of licence files of one
directory the first by path and text; repeated rows give equal rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbars.llm.work import work_dir, written

THRESHOLD = 0.6
BROADCAST_ROWS = 200_000
SPEAKS = "licen[cs]e|copyright|rights reserved|spdx"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Usual one-line notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
]
# A window is as long as its passage, so it must be closer than a line.
WINDOW_THRESHOLD = 0.75
WHOLE_THRESHOLD = 0.9
# Stands beside the notices of other licences, which go before it.
RESERVED = "Proprietary"
# Words of a mention; a window starts at every fourth part of its length.
MENTIONS = "licen[cs]e|copyright|reserved|spdx"
TAG = r"(?i)spdx-license-identifier\s*:\s*\(*([A-Za-z0-9.+-]+)"
# Headers over several lines, and openings of licence files.
PASSAGES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "licence string, text string")


def default_passages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES + PASSAGES, "licence string, text string")


def default_texts(spark: SparkSession) -> DataFrame:
    """Full licence texts, read by the driver from the package."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return spark.createDataFrame([(f.stem, f.read_text("utf-8")) for f in files], "licence string, text string")


def _low(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def _terms(text: Column) -> Column:
    return F.array_remove(F.split(_low(text), "[^a-z0-9]+"), "")


def weights(templates: DataFrame) -> DataFrame:
    """``term``, ``idf``, and ``templates``: its weight in each template, of length one together."""
    terms = templates.select("licence", F.explode(_terms(F.col("text"))).alias("term")).groupBy("licence", "term").agg(F.count("*").alias("tf"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(templates.agg(F.countDistinct("licence").alias("n"))))
    terms = terms.join(idf.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = terms.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    terms = terms.join(norms, "licence").select("term", "idf", "licence", (F.col("w") / F.col("norm")).alias("w"))
    return terms.groupBy("term").agg(F.max("idf").alias("idf"), F.collect_list(F.struct("licence", "w")).alias("templates"))


def _cosines(terms: DataFrame, templates: DataFrame) -> DataFrame:
    """``key``, ``line``, ``licence`` and ``score`` of terms (key, line, term, tf), for each line and template with a term in common."""
    known = written(weights(templates), work_dir(terms.sparkSession), "weights")
    small = F.broadcast if known.count() <= BROADCAST_ROWS else (lambda df: df)
    rare = templates.agg((F.log((1 + F.countDistinct("licence")) / 2) + 1).alias("x")).first()["x"]
    joined = terms.join(small(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = joined.groupBy("key", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = joined.select("key", "line", F.col("w").alias("own"), F.inline("templates")).groupBy("key", "line", "licence").agg(F.sum(F.col("own") * F.col("w")).alias("dot"))
    return dots.join(norms, ["key", "line"]).select("key", "line", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def _best(scores: DataFrame) -> DataFrame:
    best = scores.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("x"))
    return best.select("key", F.col("x.licence").alias("licence"), (-F.col("x.s")).alias("score"))


def _sized(templates: DataFrame) -> DataFrame:
    """Each text as a template of its own, named by its licence, its hash and its length in words."""
    n = F.size(_terms(F.col("text")))
    return templates.select(F.concat_ws("#", "licence", F.xxhash64("text"), n).alias("licence"), "text", n.cast("long").alias("n")).filter("n > 0")


def _named(scores: DataFrame) -> DataFrame:
    parts = F.split("licence", "#")
    return scores.select("key", "line", parts[0].alias("licence"), parts[2].cast("long").alias("length"), "score")


def headers(spoken: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``key`` (MD5 of the text), ``licence`` and ``score`` of the best line, for each distinct text with one over the threshold."""
    lines = spoken.select("key", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.col("line").rlike(f"(?i){SPEAKS}")).distinct()
    # a line of any length is named by its hash from here on
    terms = lines.select("key", F.xxhash64("line").alias("line"), F.explode(_terms(F.col("line"))).alias("term")).groupBy("key", "line", "term").agg(F.count("*").alias("tf"))
    return _best(_cosines(terms, templates).filter(F.col("score") >= threshold))


def passages(spoken: DataFrame, found: DataFrame, templates: DataFrame, texts: DataFrame) -> DataFrame:
    """``key``, ``licence`` and ``score`` of each text: by SPDX tag, else as a whole, else of the line ``found`` or the best window."""
    where = work_dir(spoken.sparkSession)
    spoken = spoken.select("key", "text", _terms(F.col("text")).alias("terms"))
    left = spoken.join(found.filter(F.col("licence") != RESERVED).select("key"), "key", "left_anti")
    licences = templates.select("licence").union(texts.select("licence")).distinct()
    tag = F.explode(F.regexp_extract_all("text", F.lit(TAG), 1))
    tags = spoken.select("key", tag.alias("tag")).select("key", F.regexp_replace(F.lower("tag"), r"(-only|-or-later|\+|[.-]+)$", "").alias("tag"))
    tags = tags.join(F.broadcast(licences.withColumn("tag", F.lower("licence"))), "tag").select("key", "licence", F.lit(1.0).alias("score"))

    sized = _sized(templates)
    lengths = F.broadcast(sized.select("n", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / 4)).alias("step")).distinct())
    # the windows about mentions that are close to each other are the same
    at = left.select("key", F.posexplode("terms").alias("at", "term")).filter(F.col("term").rlike(MENTIONS)).select("key", "at").crossJoin(lengths)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("at") - F.col("n") + 1) / F.col("step")))
    at = at.select("key", "n", "step", F.explode(F.sequence(first, F.floor(F.col("at") / F.col("step")))).alias("k")).select("key", "n", (F.col("k") * F.col("step")).alias("start")).distinct()
    window = F.slice("terms", (F.col("start") + 1).cast("int"), F.col("n").cast("int"))
    windows = at.join(left.select("key", "terms"), "key").select("key", F.struct("n", "start").alias("line"), F.explode(window).alias("term"))
    near = _named(_cosines(windows.groupBy("key", "line", "term").agg(F.count("*").alias("tf")), sized)).filter((F.col("line.n") == F.col("length")) & (F.col("score") >= WINDOW_THRESHOLD))
    # each way is a table of its own, which keeps the driver's plans small
    near = written(near.select("key", "licence", "score"), where, "near")

    full = _sized(texts)
    low, high = full.agg(F.min("n") / 2, F.max("n") * 2).first()
    whole = spoken.filter(F.size("terms").between(low or 0, high or 0)).select("key", F.size("terms").alias("line"), F.explode("terms").alias("term"))
    whole = _named(_cosines(whole.groupBy("key", "line", "term").agg(F.count("*").alias("tf")), full)).filter(F.col("line").between(F.col("length") / 2, F.col("length") * 2) & (F.col("score") >= WHOLE_THRESHOLD))
    whole = written(whole.select("key", "licence", "score"), where, "whole")
    lines = found.unionByName(near)
    ranks = [(written(tags, where, "tags"), F.lit(0)), (whole, F.lit(1)), (lines, F.when(F.col("licence") == RESERVED, 3).otherwise(2))]
    ranked = [x.withColumn("rank", rank) for x, rank in ranks]
    ranked = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return _best(ranked.join(ranked.groupBy("key").agg(F.min("rank").alias("rank")), ["key", "rank"]))


def _spoken(files: DataFrame, text_col: str) -> DataFrame:
    return files.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(f"(?i){SPEAKS}")).select("text", _text_key(F.col("text")).alias("key"))


def _text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "/[^/]*$", "")


def scan(files: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", licence_name: str = "LICENSE", threshold: float = THRESHOLD, further: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The licence of every file.

    ``further`` holds passages and full texts, by default those of this module.

    Returns ``doc_id``, ``path``, ``own_licence`` and ``score`` (of its best
    header or passage, else null), ``inherited`` (of the nearest directory with a licence
    file) and ``licence`` (its own, else the inherited one).
    """
    path = F.coalesce(F.col(path_col), F.lit(""))
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), _text_key(F.col(text_col)).alias("key"), _directory(path).alias("directory"))
    where = work_dir(files.sparkSession)
    spoken = written(_spoken(files, text_col).dropDuplicates(["key"]), where, "spoken")
    found = written(headers(spoken, templates, threshold), where, "headers")
    own = passages(spoken, found, *(further or (default_passages(files.sparkSession), default_texts(files.sparkSession))))
    # what is summed up by key or directory is written before files are joined with it, so that Spark can split a large directory
    rows = written(rows.join(written(own, where, "own"), "key", "left"), where, "files")
    named = rows.filter(F.col("path").rlike(f"(^|/){licence_name}$") & F.col("licence").isNotNull())
    given = written(named.groupBy("directory").agg(F.min_by("licence", F.struct("path", "key")).alias("inherited")), where, "given")
    parts = F.split("directory", "/")
    above = rows.select("directory").distinct().select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor")))).alias("x"))
    above = above.select("directory", "x.*").join(given.withColumnRenamed("directory", "ancestor"), "ancestor")
    nearest = written(above.groupBy("directory").agg(F.max_by("inherited", "depth").alias("inherited")), where, "nearest")
    return rows.join(nearest, "directory", "left").select("doc_id", "path", F.col("licence").alias("own_licence"), "score", "inherited", F.coalesce("licence", "inherited").alias("licence"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``docs`` as a tree: a directory for each source, in it one for each language; some ids are licence files of either."""
    top, low = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    path = F.when(F.col("doc_id") % 40 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).when(F.col("doc_id") % 40 == 20, F.concat_ws("/", top, low, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, low, F.col("doc_id")))
    return docs.withColumn("path", path)


def _values() -> str:
    return ", ".join("('" + name + "', '" + text + "')" for name, text in TEMPLATES)


SQL = r"""
WITH tp(licence, text) AS (VALUES @),
d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, 'none') AS top, coalesce(lang, 'none') AS low FROM documents),
p AS (SELECT r, doc_id, text, CASE WHEN doc_id % 40 = 0 THEN top || '/LICENSE' WHEN doc_id % 40 = 20 THEN top || '/' || low || '/LICENSE'
             ELSE concat_ws('/', top, low, doc_id) END AS path, top, low FROM d),
tt AS (SELECT licence, term, count(*) AS tf FROM (SELECT licence, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM tp) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tp))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT licence, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY licence)) AS w FROM tt JOIN idf USING (term)),
l AS (SELECT DISTINCT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM p) WHERE regexp_matches(line, '(?i)licen[cs]e|copyright|rights reserved|spdx')),
lt AS (SELECT r, line, term, count(*) AS tf FROM (SELECT r, line, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM l) GROUP BY ALL),
lw AS (SELECT r, line, term, tf * coalesce(idf, ln((1 + (SELECT count(*) FROM tp))::DOUBLE / 2) + 1) AS w FROM lt LEFT JOIN idf USING (term)),
ln_ AS (SELECT r, line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
sc AS (SELECT r, line, licence, sum(lw.w * tw.w) AS dot FROM lw JOIN tw USING (term) GROUP BY ALL),
own AS (SELECT r, licence, score FROM (SELECT r, licence, round(dot / norm, 6) AS score, row_number() OVER (PARTITION BY r ORDER BY round(dot / norm, 6) DESC, licence) AS k
        FROM sc JOIN ln_ USING (r, line)) WHERE k = 1 AND score >= 0.6),
f AS (SELECT p.*, own.licence AS own_licence, score FROM p LEFT JOIN own USING (r)),
up AS (SELECT top, min_by(own_licence, md5(text)) AS licence FROM f WHERE doc_id % 40 = 0 AND own_licence IS NOT NULL GROUP BY top),
near AS (SELECT top, low, min_by(own_licence, md5(text)) AS licence FROM f WHERE doc_id % 40 = 20 AND own_licence IS NOT NULL GROUP BY top, low)
SELECT doc_id, path, own_licence, score, CASE WHEN doc_id % 40 = 0 THEN up.licence ELSE coalesce(near.licence, up.licence) END AS inherited,
       coalesce(own_licence, CASE WHEN doc_id % 40 = 0 THEN up.licence ELSE coalesce(near.licence, up.licence) END) AS licence
FROM f LEFT JOIN up USING (top) LEFT JOIN near ON near.top = f.top AND near.low = f.low
""".replace("@", _values())
