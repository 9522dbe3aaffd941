"""Licences of files: TF-IDF cosine of their lines to templates, then inheritance from the nearest directory above.

Every line of a file is compared as a header with the notices below; a licence file (LICENSE, COPYING, ...) is compared
as a whole and line by line. Vectors are sparse: term counts times the terms' inverse frequencies among the templates, words that no
template has count with the largest weight in the length only. A line can reach the threshold only if it holds a term
of a small set that is computed from the weights (a template without these terms is too short to reach it), so other lines
are left out before any term is listed; no pair that reaches the threshold is lost.

A file's own licence is its best line's. A directory's is that of the best licence file in it. A file without its own
takes that of the nearest directory above it, found by joins on directory paths: directories, not files, are listed with their
ancestors, so a directory with very many files is one row there.

Only DataFrame functions run. The templates are fixed, so what is broadcast is too. Defined results: null and
empty texts have no own licence. A null path has no directory and inherits nothing; rows that repeat a path are one file,
whose licence is the best of theirs. Ties go to the first template, then to the first path. Scores are rounded to six digits. An
empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.6
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]es?|copying|notice|unlicense)(\.[a-z]+)?$"
# Licence names and the notices by which files declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
)


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


class Weights:
    """Vectors of the templates, the terms' weights, and the terms without which no line reaches the threshold."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        texts = [terms_of(t) for _, t in templates]
        seen = {w: sum(w in t for t in texts) for t in texts for w in t}
        self.names = [name for name, _ in templates]
        self.idf = {w: 1 + math.log((1 + len(texts)) / (1 + n)) for w, n in seen.items()}
        self.unseen = 1 + math.log(1 + len(texts))
        self.vectors, self.cues = [], set()
        for t in texts:
            raw = {w: t.count(w) * self.idf[w] for w in t}
            length = math.sqrt(sum(x * x for x in raw.values()))
            vector = {w: x / length for w, x in raw.items()}
            self.vectors.append(vector)
            # What is left of the unit vector bounds every cosine: go on while it is long enough.
            rest = 1.0
            for w, x in sorted(vector.items(), key=lambda v: (-v[1], v[0])):
                if math.sqrt(max(0.0, rest)) < threshold - 1e-9:
                    break
                self.cues.add(w)
                rest -= x * x

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(w, x, [v.get(w, 0.0) for v in self.vectors]) for w, x in sorted(self.idf.items())]
        return spark.createDataFrame(rows, "term string, idf double, v array<double>")

    def cue(self) -> str:
        """A line that has a cue as a term matches; so may others."""
        return "(?i)(" + "|".join(re.escape(w) for w in sorted(self.cues)) + ")"


def scored(passages: DataFrame, weights: Weights) -> DataFrame:
    """path, at, template (its number), score of each passage (path, at, line) that reaches a template at all.

    A passage is one row of the result; at is the number of its line, or null for a whole file.
    """
    spark = passages.sparkSession
    # Terms are counted inside their row: sorted, each run begins where a term differs from the one before.
    numbered = passages.select("path", "at", F.monotonically_increasing_id().alias("passage"), F.array_sort(F.regexp_extract_all(F.lower("line"), F.lit(f"({TERM})"))).alias("terms")).where(F.size("terms") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = numbered.withColumn("begins", begins)
    run = lambda i, k: F.struct(F.get("terms", i).alias("term"), (F.coalesce(F.get("begins", k + 1), F.size("terms")) - i).cast("long").alias("n"))
    counts = runs.select("path", "at", "passage", F.inline(F.transform("begins", run)))
    counts = counts.join(F.broadcast(weights.table(spark)), "term", "left")
    weight = F.col("n") * F.coalesce("idf", F.lit(weights.unseen))
    sums = [F.sum(F.col("n") * F.col("idf") * F.col("v")[i]).alias(f"t{i}") for i in range(len(weights.names))]
    found = counts.groupBy("passage", "path", "at").agg(F.sqrt(F.sum(weight * weight)).alias("length"), *sums)
    best = F.greatest(*[F.struct(F.round(F.coalesce(F.col(f"t{i}") / F.col("length"), F.lit(0.0)), 6).alias("score"), F.lit(-i).alias("minus")) for i in range(len(weights.names))])
    return found.withColumn("best", best).select("path", "at", (-F.col("best.minus")).alias("template"), F.col("best.score").alias("score"))


def directory(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def licensed(files: DataFrame, keep: tuple[str, ...] = (), templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of keep, and path, licence, score, basis (file, header, inherited or none), from_path of each row of files (path, text, others)."""
    weights = Weights(templates, threshold)
    whole = F.col("path").rlike(LICENCE_FILE)
    # A line ends at a line feed, a carriage return or both.
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r\n|\n|\r"), lambda x: x.rlike(weights.cue()))
    texts = files.select("path", "text").where(F.col("path").isNotNull())
    headers = texts.select("path", F.posexplode(lines).alias("at", "line"))
    in_full = texts.where(whole).select("path", F.lit(None).cast("int").alias("at"), F.col("text").alias("line"))
    matches = scored(headers.unionByName(in_full), weights).where(F.col("score") >= threshold)
    own = matches.groupBy("path").agg(F.max(F.struct("score", (-F.col("template")).alias("minus"))).alias("x"))
    name = F.get(F.array(*map(F.lit, weights.names)), -F.col("x.minus"))
    own = written(own.select("path", name.alias("licence"), F.col("x.score").alias("score"), directory(F.col("path")).alias("directory"), whole.alias("of_file")))
    order = W.partitionBy("directory").orderBy(F.desc("score"), "path")  # licence files of a directory; map tasks keep one
    given = own.where("of_file").withColumn("nth", F.row_number().over(order)).where("nth = 1").select(F.col("directory").alias("above"), F.col("licence").alias("d_licence"), F.col("score").alias("d_score"), F.col("path").alias("d_path"))
    # Directories with their ancestors, themselves and the root among them.
    below = files.where("path IS NOT NULL").select(directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    depths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = below.select("directory", F.posexplode(F.array_distinct(F.concat(F.array(F.lit("")), depths))).alias("depth", "above"))
    nearest = above.join(given, "above").groupBy("directory").agg(F.max_by(F.struct("d_licence", "d_score", "d_path"), "depth").alias("d"))
    rows = files.select(*(F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)), "path").withColumn("directory", directory(F.col("path")))
    out = rows.join(own.drop("directory"), "path", "left").join(nearest, "directory", "left")
    basis = F.when(F.col("licence").isNotNull(), F.when(F.col("of_file"), F.lit("file")).otherwise(F.lit("header"))).when(F.col("d").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return out.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "path", F.coalesce("licence", "d.d_licence").alias("licence"), F.coalesce("score", "d.d_score").alias("score"), basis.alias("basis"), F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.col("d.d_path")).alias("from_path"))
