"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every line and every paragraph of every file is held against the templates.
Document frequencies of the templates' words are counted over all lines of
all files (the table is as small as the templates), and words outside the
templates weigh as if no line had them.  Files without a notice of their own
take the license of the licence file in the nearest directory above them,
found by joining directories with the paths of their ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.llm import common

#: Notices by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Base names, in lower case and without suffix, of files that license their directory.
LICENSE_FILES = ("license", "licence", "copying", "unlicense", "notice")
_PLAIN = {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) != "\n"}


def words(text: str) -> list[list[str]]:
    """A text's lines as lists of lower-case words; ASCII punctuation parts words."""
    return [line.split() for line in text.lower().translate(_PLAIN).split("\n")]


def segments(text: str) -> Iterator[tuple[int, list[str]]]:
    """(number of the first line, words) of every line and of every paragraph of several lines; words of none are left out."""
    held: list[str] = []
    first = many = 0
    for k, line in enumerate(words(text)):
        if line:
            yield k, line
            if not held:
                first, many = k, 0
            held += line
            many += 1
        elif held:
            if many > 1:
                yield first, held
            held = []
    if held and many > 1:
        yield first, held


def _vocabulary(templates: dict[str, list[str]]) -> set[str]:
    return {w for ts in templates.values() for t in ts for line in words(t) for w in line}


class Matcher:
    """Unit TF-IDF vectors of the templates, by word."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], lines: int, least: float):
        self.names = [(name, t) for name, ts in templates.items() for t in ts]
        self.rare = log(1 + lines) + 1
        self.idf = {w: log((1 + lines) / (1 + frequency.get(w, 0))) + 1 for w in _vocabulary(templates)}
        self.least = least
        self.by_word: dict[str, list[tuple[int, float]]] = {}
        for k, (_, t) in enumerate(self.names):
            own = [w for line in words(t) for w in line]
            weight = {w: own.count(w) * self.idf[w] for w in own}
            norm = sum(v * v for v in weight.values()) ** 0.5
            for w, v in weight.items():
                self.by_word.setdefault(w, []).append((k, v / norm))
        self.vocabulary = frozenset(self.idf)

    def best(self, text: str | None) -> tuple[str | None, float, int]:
        """(license, cosine, line) of a whole text's best segment; (None, 0, -1) if none reaches `least`.  Ties go to
        the earlier line, then the earlier template."""
        name, top, at = None, 0.0, -1
        for k, own in segments(text or ""):
            hit = self.vocabulary.intersection(own)
            if not hit:
                continue
            inside = {w: own.count(w) if len(own) > len(hit) else 1 for w in hit}
            mass = sum((n * self.idf[w]) ** 2 for w, n in inside.items())
            outside: dict[str, int] = {}
            if len(own) > sum(inside.values()):
                # a first bound without the counts of other words: each of them weighs at least once its square
                rest = len(own) - sum(inside.values())
                if mass < self.least**2 * (mass + rest * self.rare**2):
                    continue
                for w in own:
                    if w not in hit:
                        outside[w] = outside.get(w, 0) + 1
            norm = (mass + sum((n * self.rare) ** 2 for n in outside.values())) ** 0.5
            dot: dict[int, float] = {}
            for w in sorted(hit):
                for t, v in self.by_word[w]:
                    dot[t] = dot.get(t, 0.0) + inside[w] * self.idf[w] * v
            t = min(dot, key=lambda x: (-round(dot[x], 12), x))
            score = dot[t] / norm
            if score >= self.least and score > top + 1e-12:
                name, top, at = self.names[t][0], min(score, 1.0), k
        return name, top, at


_COUNT = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("path", T.StringType()), T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("line", T.IntegerType())])


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Lines that hold each word, and all lines under the empty word: one row per word and task."""
    counts: dict[str, int] = {"": 0}
    for batch in common.rows(batches, "text"):
        for text in batch.column("text").to_pylist():
            for line in words(text or ""):
                if line:
                    counts[""] += 1
                    for w in vocabulary.intersection(line):
                        counts[w] = counts.get(w, 0) + 1
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def _match(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[pa.RecordBatch]:
    for batch in common.rows(batches, "text"):
        name, score, line = zip(*[matcher.best(t) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("path"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(line, pa.int32())], names=FOUND.names)


def notices(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.7, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Per file: row, path, and the license, cosine and line (from 0, or -1) of the best notice in its whole text."""
    templates = templates or TEMPLATES
    vocabulary = frozenset(_vocabulary(templates))
    texts = files.select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(partial(_frequencies, vocabulary=vocabulary), _COUNT).groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {r.word: r.n for r in counted.collect()}  # as many rows as the templates have words
    matcher = Matcher(templates, frequency, frequency.pop("", 0), least)
    rows = files.select(F.col(id_col).cast("long").alias("row"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_match, matcher=matcher), FOUND)


def inherit(found: DataFrame) -> DataFrame:
    """row, path, license, score, via ('header', 'file', 'inherited' or null) and from_path for rows of notices().

    A licence file (LICENSE, COPYING, ... with or without a suffix) licenses
    its directory and all below it, down to the next one; of several in a
    directory the best match counts, then the smaller path.  A file's own
    notice goes before what it would inherit.  A null path is in no directory.
    """
    base = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    files = found.withColumn("dir", parent).withColumn("is_file", F.coalesce(stem.isin(*LICENSE_FILES) | base.isin(*LICENSE_FILES), F.lit(False)))
    licensed = files.where("is_file and license is not null and dir is not null").groupBy("dir").agg(F.min_by(F.struct("license", "score", "path"), F.struct(-F.round("score", 9), "path")).alias("best"))  # cosines differ in their last digits
    licensed = licensed.select(F.col("dir").alias("ancestor"), F.col("best.license").alias("up_license"), F.col("best.score").alias("up_score"), F.col("best.path").alias("from_path"))
    folders = files.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    # each directory with itself and all above it: as many rows as it is deep
    above = folders.withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(parts)))).withColumn("ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).where("depth = 0 or ancestor <> ''")
    # nearly every directory is below '' and its source's; such frequent ancestors are few and go by broadcast
    counted = common.cut(licensed.join(above.groupBy("ancestor").agg(F.count("*").alias("below")), "ancestor"), "licensed")
    met = common.join_counted(above, counted, "ancestor", "below")
    nearest = met.groupBy("dir").agg(F.max_by(F.struct("up_license", "up_score", "from_path"), "depth").alias("up"))
    sizes = files.where("dir is not null").groupBy("dir").agg(F.count("*").alias("files"))
    known = common.cut(sizes.join(nearest, "dir", "left"), "nearest")
    nowhere = files.where("dir is null").withColumn("up", F.lit(None).cast(known.schema["up"].dataType)).withColumn("files", F.lit(1).cast("long"))
    joined = common.join_counted(files, known, "dir", "files").unionByName(nowhere)
    own = F.col("license").isNotNull()
    return joined.select(
        "row",
        "path",
        F.when(own, F.col("license")).otherwise(F.col("up.up_license")).alias("license"),
        F.when(own, F.col("score")).otherwise(F.coalesce("up.up_score", F.lit(0.0))).alias("score"),
        F.when(own & F.col("is_file"), "file").when(own, "header").when(F.col("up").isNotNull(), "inherited").alias("via"),
        F.when(own, F.col("path")).otherwise(F.col("up.from_path")).alias("from_path"),
    )


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.7, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """notices() and inherit() in one.  Null and empty texts hold no notice; repeated rows come back as often; an empty
    table gives no rows; other columns are not read."""
    return inherit(common.cut(notices(files, templates, least, id_col, path_col, text_col), "notices"))


def as_files(docs: DataFrame) -> DataFrame:
    """`documents` laid out as a tree: source/thousands/fifties/id.txt.  The first document of each folder stands for its
    LICENSE file, as the tables have no paths of their own."""
    thousand, fifty = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 50)
    name = F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", thousand, F.lit("LICENSE"))).when(F.col("doc_id") % 50 == 0, F.concat_ws("/", "source", thousand, fifty, F.lit("LICENSE"))).otherwise(F.concat_ws("/", "source", thousand, fifty, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return docs.select("doc_id", name.alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, found or inherited."""
    return scan(as_files(common.table(spark, sf_dir, "documents"))).withColumnRenamed("row", "doc_id")
