"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a file, and every licence file as a whole, is compared with short texts of
well-known licenses. Term weights come from document frequencies over all files, for
every term of a template or of a unit that is scored. A unit can only
reach the threshold if it holds one of a template's signature terms: the lightest terms
are left out as long as their share of the template's length stays below the threshold
(Cauchy-Schwarz), so this test loses nothing. Only units that pass are split into terms.

A file with no match of its own takes the license of the licence file in the nearest
directory above, found by joining its ancestor paths with the licence files' folders.

Only built-in functions. Defined cases: NULL text matches nothing; a NULL path has no
directory and inherits nothing; of equal scores the first template by name counts, of
several licence files in one directory the best score, then the first license by name;
repeated rows are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.shaping import evaluate_once, spread_join
from tidewatch.llm.decontaminate import words_of
from tidewatch.session import stored

THRESHOLD = 0.6
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"

# Names and short notices of licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """`template` (its number), `license`, `term` and `tf`."""
    rows = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for i, (name, text) in enumerate(templates)))))
    terms = rows.select("template", "license", F.explode(words_of(F.col("text"))).alias("term"))
    return terms.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def frequencies(files: DataFrame, text: str) -> DataFrame:
    """`term` and `df`, the number of files that hold it."""
    words = F.array_distinct(words_of(F.col(text)))
    return files.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(total: int) -> Column:
    return F.log((F.lit(total) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0


def weighted_terms(terms: DataFrame, counted: DataFrame, total: int) -> DataFrame:
    """Adds `idf` and `weight` to the template terms."""
    # of all counted terms only the few of the templates are moved
    held = counted.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    weighted = terms.join(held, "term", "left").withColumn("idf", idf(total))
    return weighted.withColumn("weight", F.col("tf") * F.col("idf"))


def signature(weighted: DataFrame, threshold: float) -> list[str]:
    """Terms of which a unit must hold one to reach the threshold with some template."""
    rows = weighted.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("weight", "term"))).alias("t")).collect()
    chosen = set()
    for row in rows:
        whole, light = sum(t.weight ** 2 for t in row.t), 0.0
        for t in row.t:
            light += t.weight ** 2
            if light >= threshold ** 2 * whole * (1 - 1e-9):
                chosen.add(t.term)
    return sorted(chosen)


def matched(files: DataFrame, key: str, text: str, whole: Column, threshold: float = THRESHOLD,
            templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """`key`, `license` and `score` of the best template of each file that reaches the threshold.

    `key` is unique. `whole` says which files are also compared as one unit.

    Each file of a stored table costs a process for its permissions where Hadoop lacks its
    native library. So the weights, as few as the templates' terms, are one file, the units
    are stored before a shuffle deals them out, and no table has more files than the input splits.
    """
    spark = files.sparkSession
    slim = files.select(F.col(key).alias("key"), F.col(text).alias("text"), whole.alias("whole"))
    counted = stored(frequencies(slim, "text").coalesce(max(1, slim.rdd.getNumPartitions())), "document-frequencies")
    total = slim.count()
    weights = weighted_terms(template_terms(spark, templates or TEMPLATES), counted, total)
    weights = stored(weights.coalesce(1), "template-weights")
    marks = signature(weights, threshold)
    body = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(body, "\n")
    units = slim.select("key", F.posexplode(F.when(F.col("whole"), F.array_append(parts, body)).otherwise(parts))
                        .alias("unit", "line"))
    units = evaluate_once(units, words_of(F.col("line")), "words").drop("line")
    units = stored(units.filter(F.arrays_overlap("words", F.array(*map(F.lit, marks)))), "scored-units")
    terms = units.select("key", "unit", F.explode("words").alias("term"))
    tf = terms.groupBy("key", "unit", "term").agg(F.count("*").alias("n"))
    rarity = counted.join(terms.select("term").distinct(), "term", "left_semi").select("term", idf(total).alias("idf"))
    lengths = spread_join(tf, rarity, ["term"]).groupBy("key", "unit").agg(
        F.sqrt(F.sum(F.pow(F.col("n") * F.col("idf"), F.lit(2)))).alias("length"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    sided = weights.join(norms, "template").select(
        "template", "license", "term", (F.col("weight") * F.col("idf") / F.col("norm")).alias("share"))
    dots = tf.join(sided, "term").groupBy("key", "unit", "template", "license").agg(
        F.sum(F.col("n") * F.col("share")).alias("dot"))
    scored = dots.join(lengths, ["key", "unit"]).select(
        "key", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    best = scored.filter(F.col("score") >= threshold).groupBy("key").agg(
        F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"))
    return best.select("key", F.col("best.license").alias("license"), (-F.col("best.low")).alias("score"))


def ancestors(path: Column) -> Column:
    """The directories above a file, nearest first, each as (steps, directory); the root is ''."""
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    depth = F.size(parts) - 1
    steps = F.when(path.isNotNull() & (depth > 0), F.sequence(F.lit(1), depth))
    return F.transform(F.coalesce(steps, F.array().cast("array<int>")), lambda s: F.struct(
        s.alias("steps"), F.array_join(F.slice(parts, 1, F.size(parts) - s), "/").alias("dir")))


def scan(files: DataFrame, path: str = "path", text: str = "text", threshold: float = THRESHOLD,
         templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """`row` (the input columns without the text), own license and score, and the license that holds.

    `via` is the directory it comes from: NULL for a match in the file itself or none.
    """
    kept = [c for c in files.columns if c != text]
    rows = files.select(F.struct(*kept).alias("row"), F.col(path).alias("path"), F.col(text).alias("text"),
                        F.monotonically_increasing_id().alias("key"))
    rows = rows.withColumn("is_license", F.coalesce(
        F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False)))
    # numbered once, so that equal rows stay apart
    rows = stored(rows, "numbered-files")
    own = matched(rows, "key", "text", F.col("is_license"), threshold, templates)
    named = rows.drop("text").join(own, "key", "left")
    named = stored(named.coalesce(max(1, rows.rdd.getNumPartitions())), "files")
    folder = F.get(ancestors(F.col("path")), F.lit(0))["dir"]
    folders = named.filter(F.col("is_license") & F.col("license").isNotNull()).select(
        folder.alias("dir"), F.struct((-F.col("score")).alias("low"), F.col("license").alias("name")).alias("best"))
    folders = folders.filter("dir is not null").groupBy("dir").agg(F.min("best")["name"].alias("given"))
    above = named.filter("license is null").select("key", F.explode(ancestors(F.col("path"))).alias("up"))
    above = above.select("key", "up.steps", "up.dir")
    near = spread_join(above, folders, ["dir"]).groupBy("key").agg(
        F.min(F.struct("steps", "dir", "given")).alias("near"))
    joined = named.join(near, "key", "left")
    return joined.select(
        "row", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", "near.given").alias("license"), F.col("near.dir").alias("via"))
