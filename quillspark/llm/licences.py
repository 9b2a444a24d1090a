"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

Files are (path, text). Passages are the lines that carry a cue, all lines of a file that speak of a licence
together, the sentences with a cue, whole lines or over line ends and comment marks, and windows of `SIZES`
words wherever a cue is. The cues are derived from the templates' vectors (`cue_terms`): a passage without any of them cannot
have a cosine of `LEAST` but by common words and numbers alone, which are no licence; so leaving it out loses nothing. So a one-line header, a line with prose
behind it and a notice wrapped over many lines can match in a file of any length. Windows begin at
every third of their size, so a word is in three of each size however many cues a file has. A passage and a
template are vectors of term frequency times idf; idf is that of the templates (a bounded table that
ships with this module), terms of no template weigh most. The cosine comes from an equi-join on the
few terms the two share. The best template at `LEAST` or more is the file's own licence.

A file that is mostly licence text (`MOSTLY` of its words are in cue lines), or is named like one, speaks
for its directory. A file without a licence of its own inherits from its nearest ancestor
directory that has one: directories, not files, meet their ancestors, and files join their own
directory, so a directory with very many files is a join key once.

DataFrame functions only. A null or empty text has no licence of its own; a null path is in no
directory and inherits nothing. Of equal cosines the template first in the alphabet wins; of several
licence files in a directory the best, then the first by path. Rows that repeat are judged alike; rows that share a
file are one file with all their passages, which speaks for the directory of its least path. Only file, path and text are
read. Texts of any length are scanned whole: what holds no cue cannot match. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

LEAST = 0.55
MOSTLY = 0.5
#: Lines that make a file speak of its licence, for whether most of it does.
CUE = r"(?i)licen[sc]|copyright|\(c\)|spdx|warrant|redistribut|permission[\s\W]+is[\s\W]+hereby|public[\s\W]+domain"
#: Terms that texts are full of (`mit` is a German word); they and numbers count in a cosine, but alone they are no licence.
COMMON = frozenset("a above all an and any are as at be by can code copy either except file files following for form forms free from general has have http in including into is it its kind law list may mit must name names neither no nor not of on only or other person possible prior program public rights software source specific such terms that the this to under use used version with without work writing written you your".split())
#: Words of a window; templates have 2 to 80.
SIZES = (12, 18, 27, 42, 63, 96)
#: A line end with the comment marks around it, unless the next line is empty.
WRAP = r"[^\S\n]*\n[^\S\n]*(?:[#*;%>|!]+|//+|--+|<!--)?[^\S\n]*(?=[^\s#*;%>|!/-])"
NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"

#: Short public notices, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+(?:[.-][a-z0-9]+)*)"), 1)


def counts(df: DataFrame, ident: list[str], text: str) -> DataFrame:
    """(ident, term, tf), frequencies counted in the row."""
    listed = F.array_sort(terms(F.col(text)))
    return df.select(*ident, F.explode(listed).alias("term")).groupBy(*ident, "term").agg(F.count("*").alias("tf"))


def template_vectors(spark: SparkSession, templates: tuple = TEMPLATES) -> tuple[DataFrame, float]:
    """(template, licence, term, idf, weight) with vectors of length 1, and the idf of other terms."""
    rows = spark.createDataFrame([(k, spdx, text) for k, (spdx, text) in enumerate(templates)], "template int, licence string, text string")
    tf = counts(rows, ["template", "licence"], "text")
    n = len(templates)
    df = tf.groupBy("term").agg((F.log((n + 1.0) / (F.count("*") + 1.0)) + 1.0).alias("idf"))
    weighed = tf.join(df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    out = weighed.join(norm, "template").select("template", "licence", "term", "idf", (F.col("w") / F.col("norm")).alias("weight"))
    import math

    return staged(out, "licence-templates"), math.log(n + 1.0) + 1.0


def distinct(term: str) -> bool:
    return term not in COMMON and any(c.isalpha() for c in term)


def cue_terms(vectors: list[tuple[int, str, float]], least: float = LEAST) -> list[str]:
    """(template, term, weight) -> terms of which every passage that is `least` like a template, and not in common terms alone, has one.

    What shares only the other terms of a template is at most as like it as these terms' part of its length (by Cauchy and
    Schwarz). They are left out only as long as that part is below `least`; a template with more common terms than that
    has all its others among the cues.
    """
    by: dict[int, dict[str, float]] = {}
    for template, term, weight in vectors:
        by.setdefault(template, {})[term] = weight
    chosen: set[str] = set()
    for own in by.values():
        left = sum(w * w for t, w in own.items() if t not in chosen)
        for term in sorted((t for t in own if distinct(t)), key=lambda t: (-own[t], t)):
            if left < least * least * 0.999:
                break
            if term not in chosen:
                chosen.add(term)
                left -= own[term] ** 2
    return sorted(chosen)


def cued(files: DataFrame, cues: list[str]) -> DataFrame:
    """(file, path, n_words, lines, said, sentences, windows): files with a cue, and their passages with one; `said` are the lines that speak of a licence."""
    # A cue may also be a part of a longer term here; windows are exact.
    any_cue = "(?iu)(?<![a-z0-9])(?:" + "|".join(x.replace(".", r"\.") for x in cues) + ")(?![a-z0-9])"
    has = files.where(F.lower("text").rlike(any_cue))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(any_cue))
    whole = F.regexp_replace("text", WRAP, " ")
    sentences = F.filter(F.split(whole, r"(?<=[.;:!?])\s+|\n"), lambda x: x.rlike(any_cue))  # one ends with its mark, or at an empty line
    rows = has.select("file", "path", F.size(F.split("text", r"\s+")).alias("n_words"), lines.alias("lines"), sentences.alias("sentences"), terms(F.col("text")).alias("terms"))
    return rows.select("file", "path", "n_words", "lines", F.filter("lines", lambda x: x.rlike(CUE)).alias("said"), "sentences", windows(F.col("terms"), cues).alias("windows"))


def windows(words: Column, cue: list[str]) -> Column:
    """Windows of each size with a cue, at every third of the size."""
    cues = F.filter(F.transform(words, lambda x, i: F.when(x.isin(*cue), i)), lambda i: i.isNotNull())

    def of(size: int) -> Column:
        step = size // 3
        last = F.transform(cues, lambda p: F.floor(p / step).cast("int"))
        at = F.array_distinct(F.flatten(F.transform(last, lambda k: F.sequence(F.greatest(k - 2, F.lit(0)), k))))
        return F.transform(at, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))

    return F.array_distinct(F.concat(*[of(size) for size in SIZES]))


def passages(cues: DataFrame) -> DataFrame:
    """(file, part, passage): a file's passages by number, and all lines that speak of a licence together as -1."""
    each = F.array_distinct(F.concat("lines", "sentences", "windows"))
    both = F.concat(F.transform(each, lambda x, i: F.struct(i.alias("part"), x.alias("passage"))), F.array(F.struct(F.lit(-1).alias("part"), F.array_join("said", " ").alias("passage"))))
    return cues.select("file", F.inline(both))


def cosines(parts: DataFrame, vectors: DataFrame, other: float) -> DataFrame:
    """(file, licence, score) of each file's best passage and template."""
    idf = F.broadcast(vectors.select("term", "idf").distinct())  # as many rows as the templates have terms
    tf = counts(parts, ["file", "part"], "passage").join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = tf.groupBy("file", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.where("idf IS NOT NULL").drop("idf").join(F.broadcast(vectors), "term").groupBy("file", "part", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.max(~F.col("term").isin(*COMMON) & F.col("term").rlike("[a-z]")).alias("own")).where("own")
    scored = dots.join(norms, ["file", "part"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9))
    by_licence = scored.groupBy("file", "licence").agg(F.max("score").alias("score"))
    return by_licence.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("file", "b.licence", (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    """All up to the last slash, '' for a file at the top, null for a null path."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit("")).alias("dir")


def ancestors(path: Column) -> Column:
    """The directory itself and all above, with their depth; '' is the top at depth 0."""
    steps = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("above")))
    top = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))
    return F.when(path == "", top).otherwise(F.concat(top, inner))


def licensed(files: DataFrame) -> DataFrame:
    """(file, path, text) -> file, path, licence, score, how (header, file, inherited), from_dir.

    `file` identifies a row; rows that share it are one file.
    """
    spark = files.sparkSession
    vectors, other = template_vectors(spark)
    # As many rows as the templates have terms.
    rows = [(r["template"], r["term"], r["weight"]) for r in vectors.select("template", "term", "weight").collect()]
    cues = staged(cued(files, cue_terms(rows)), "licence-cues")  # texts are read once; the rest works on their passages
    own = cosines(passages(cues), vectors, other).where(F.col("score") >= LEAST)
    cue_words = F.when(F.size("said") > 0, F.size(F.split(F.array_join("said", " "), r"\s+"))).otherwise(0)
    sized = cues.select("file", "path", ((cue_words >= MOSTLY * F.col("n_words")) | F.coalesce(F.col("path").rlike(NAMED), F.lit(False))).alias("speaks"))
    # Rows that share a file are one file, at the least of their paths.
    own = staged(own.join(sized.groupBy("file").agg(F.min("path").alias("path"), F.max("speaks").alias("speaks")), "file"), "licence-own")
    said = own.where("speaks AND path IS NOT NULL").groupBy(directory(F.col("path"))).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("b")).select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"))
    dirs = files.where("path IS NOT NULL").select(directory(F.col("path"))).distinct()
    nearest = dirs.select("dir", F.inline(ancestors(F.col("dir")))).join(said, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("b")).select("dir", F.col("b.above").alias("from_dir"), F.col("b.dir_licence").alias("dir_licence"))
    rows = files.select("file", "path", directory(F.col("path"))).join(own.select(F.col("file"), F.col("licence").alias("own_licence"), "score", "speaks"), "file", "left").join(nearest, "dir", "left")
    is_own = F.col("own_licence").isNotNull()
    return rows.select(
        "file", "path", F.coalesce("own_licence", "dir_licence").alias("licence"), "score",
        F.when(F.col("speaks"), "file").when(is_own, "header").when(F.col("dir_licence").isNotNull(), "inherited").alias("how"),
        F.when(~is_own, F.col("from_dir")).alias("from_dir"),
    )


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: 50 to a directory, directories by source."""
    docs = table(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 50).cast("string")
    files = docs.select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", folder, F.col("doc_id").cast("string")).alias("path"), "text")
    return licensed(files).withColumnRenamed("file", "doc_id")


QUERIES = {"op7_licence_scan": op7_licence_scan}
SQL: dict[str, str] = {}
