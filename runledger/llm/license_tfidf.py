"""License scans: cosine of notices with license templates, inherited down directories.

A unit is a line of a text, a block of neighbouring lines that hold template words, or
the whole text.  Its terms are its distinct words but for stop words; a template word
weighs by its inverse document frequency over all texts, any other word as one never
seen.  The cosine with each template is summed by joining terms, so that only units with
template words take part.  Whole texts are also measured against full license texts, over the
words of those.

A text with a line or block close to a template has that license (``header``).  A text
that is close to a template or a full text as a whole is a licence file, and so is one named LICENSE,
LICENCE or COPYING with a header; it also covers its directory.  Texts without a license
of their own take that of the nearest directory above them (``inherited``).

All of it is Spark SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm.batches import join_counted
from runledger.llm.license_texts import FULL_TEXTS
from runledger.session import write_scratch

# The notices by which these licenses are usually named.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)
STOP_WORDS = tuple("a an and any are as at be by can for from in is it may not of on or that the this to was with you".split())

WORDS = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
_FILE = r"(?i)(^|/)(LICEN[SC]E|COPYING)(\.[a-z]+)?$"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def _texts(values: Sequence[str]) -> Column:
    """Words as one constant: a literal for each would make the plan as large as the templates."""
    return F.split(F.lit(" ".join(values)), " ")


def _template_terms(spark: SparkSession, notices: Sequence[tuple[str, str]], full_texts: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, full, term): as many rows as the given templates have words."""
    rows = [(i, *t, i >= len(notices)) for i, t in enumerate([*notices, *full_texts])]
    given = spark.createDataFrame(rows, "template int, license string, body string, full boolean")
    return given.select("template", "license", "full", F.explode(
        F.array_except(_words(F.col("body")), _texts(STOP_WORDS))).alias("term"))


def own_licenses(
    files: DataFrame, templates: Sequence[tuple[str, str]], full_texts: Sequence[tuple[str, str]], least: float,
) -> DataFrame:
    """(path, text_hash, header, whole): the best template of a line or block, and of the
    whole text, as (cosine, license) with a cosine of ``least`` or more, else null."""
    spark = files.sparkSession
    terms = F.broadcast(write_scratch(_template_terms(spark, templates, full_texts)))
    words_of: dict[bool, list[str]] = {False: [], True: []}
    for r in terms.select("full", "term").distinct().orderBy("term").collect():
        words_of[r.full].append(r.term)

    stops, known, known_full = _texts(STOP_WORDS), _texts(words_of[False]), _texts(words_of[True])
    either = _texts(sorted({*words_of[False], *words_of[True]}))

    def others(terms: str) -> Column:
        return F.size("words") - F.size(terms) - F.size(F.array_intersect("words", stops))

    def distinct_words(units: DataFrame, text: str) -> DataFrame:
        return units.withColumn("words", F.array_distinct(_words(F.col(text))))

    key = ["path", "text_hash"]
    wholes = write_scratch(
        distinct_words(files.select("path", F.xxhash64("text").alias("text_hash"), "text"), "text")
        .withColumn("hits", F.array_intersect("words", either))
        .withColumns({"terms": F.array_intersect("hits", known), "full_terms": F.array_intersect("hits", known_full)})
        .select(*key, "terms", others("terms").alias("others"), "full_terms", others("full_terms").alias("full_others")))
    lines = write_scratch(
        distinct_words(files.select("path", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("line", "body")), "body")
        .withColumn("terms", F.array_intersect("words", known)).filter(F.size("terms") > 0)
        .select(*key, "line", "terms", others("terms").alias("others")).dropDuplicates([*key, "line"]))
    in_text = Window.partitionBy(*key).orderBy("line")
    blocks = (
        lines.withColumn("new", (F.col("line") != F.coalesce(F.lag("line").over(in_text), F.lit(-9)) + 1).cast("int"))
        .withColumn("block", F.sum("new").over(in_text)).groupBy(*key, "block")
        .agg(F.count(F.lit(1)).alias("n"), F.flatten(F.collect_list("terms")).alias("terms"), F.sum("others").alias("others"))
        .filter("n > 1").select(*key, F.lit("block").alias("kind"), F.col("block").alias("unit"),
                                F.array_distinct("terms").alias("terms"), "others"))
    units = (
        lines.select(*key, F.lit("line").alias("kind"), F.col("line").cast("bigint").alias("unit"), "terms", "others")
        .unionByName(blocks)
        .unionByName(wholes.filter(F.size("terms") > 0).dropDuplicates(key).select(
            *key, F.lit("whole").alias("kind"), F.lit(0).cast("bigint").alias("unit"), "terms", "others"))
        # a cosine is below the root of the share of known words, since none weighs more than an unknown one
        .unionByName(wholes.filter(F.size("full_terms") > 0).filter(
            F.size("full_terms") >= (least - 1e-6) ** 2 * (F.size("full_terms") + F.col("full_others"))).dropDuplicates(key).select(
            *key, F.lit("full").alias("kind"), F.lit(0).cast("bigint").alias("unit"), F.col("full_terms").alias("terms"),
            F.col("full_others").alias("others")))
    )
    n = files.count()
    seen = wholes.select(F.explode(F.array_union("terms", "full_terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row for each template word
    idf = F.broadcast(write_scratch(terms.select("term").distinct().join(seen, "term", "left").select(
        "term", (F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))))
    rare = F.log(F.lit(float(n + 1))) + 1
    template_norms = terms.join(idf, "term").groupBy("template", "license").agg(F.sum(F.col("idf") ** 2).alias("template_square"))
    weighed = (
        units.select(*key, "kind", "unit", "others", F.posexplode("terms").alias("spot", "term")).join(idf, "term"))
    at = [*key, "kind", "unit"]
    squares = weighed.groupBy(*at).agg((F.sum(F.col("idf") ** 2) + F.max("others") * rare ** 2).alias("square"))
    dots = weighed.join(terms, "term").filter(F.col("full") == (F.col("kind") == "full")).groupBy(*at, "template").agg(F.sum(F.col("idf") ** 2).alias("dot"))
    close = (
        dots.join(squares, at).join(F.broadcast(template_norms), "template")
        .withColumn("cosine", F.round(F.col("dot") / F.sqrt(F.col("square") * F.col("template_square")), 6))
        .filter(F.col("cosine") >= least)
    )
    # the greatest cosine, then the first license by name
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license"))

    def pick(of: str) -> Column:
        return F.when(F.col(of).isNotNull(), F.struct((-F.col(f"{of}.minus")).alias("cosine"), F.col(f"{of}.license")))

    found = close.groupBy(*key, F.when(F.col("kind").isin("whole", "full"), "whole").otherwise("header").alias("kind")).agg(best.alias("best"))
    return found.groupBy(*key).agg(
        F.max(F.when(F.col("kind") == "header", F.col("best"))).alias("h"),
        F.max(F.when(F.col("kind") == "whole", F.col("best"))).alias("w"),
    ).select(*key, pick("h").alias("header"), pick("w").alias("whole"))


def scan_licenses(
    files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.7,
    full_texts: Sequence[tuple[str, str]] = FULL_TEXTS,
) -> DataFrame:
    """(path, license, cosine, origin, license_path) for every row of ``files`` (path, text).

    origin is header, file, inherited or null.  Paths use ``/``.  Null texts count as
    empty; rows with a null path inherit nothing.  Equal cosines go to the first
    license by name, and of several licence files in a directory the closest, then the
    first by path counts.  Repeated rows keep their rows.  An empty table gives no rows;
    other columns are not read.
    """
    plain = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    named = plain.withColumn("path", F.coalesce(F.concat(F.lit("="), "path"), F.lit("")))  # never null
    own = own_licenses(named, templates, full_texts, least)
    joined = write_scratch(
        named.select("path", F.xxhash64("text").alias("text_hash")).join(own, ["path", "text_hash"], "left")
        .select("path", F.when(F.col("path") != "", F.regexp_replace(F.expr("substring(path, 2)"), "(^|/)[^/]*$", "")).alias("folder"),
                F.coalesce("whole", "header").alias("found"),
                F.when(F.col("whole").isNotNull() | F.col("header").isNotNull() & F.substring("path", 2, 1 << 30).rlike(_FILE), "file")
                .when(F.col("header").isNotNull(), "header").alias("origin")))
    covers = joined.filter((F.col("origin") == "file") & F.col("folder").isNotNull()).groupBy("folder").agg(
        F.min(F.struct((-F.col("found.cosine")).alias("minus"), "path", F.col("found.license").alias("license"),
                       F.col("found.cosine").alias("cosine"))).alias("by"))
    heirs = joined.filter("origin IS NULL AND folder IS NOT NULL")
    asked = heirs.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("folder", "/")
    # the folder, those above it, and the root
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    lines = asked.select("folder", "n", F.explode(F.array_distinct(above)).alias("up"))
    nearest = write_scratch(
        lines.join(covers.select(F.col("folder").alias("up"), "by"), "up", "left").groupBy("folder")
        .agg(F.max_by("by", F.when(F.col("by").isNotNull(), F.length("up"))).alias("by"), F.first("n").alias("n"))
        .withColumn("folder_hash", F.xxhash64("folder")))
    met = join_counted(heirs.withColumn("folder_hash", F.xxhash64("folder")), nearest, ["folder_hash", "folder"], joined.count())
    result = joined.filter("origin IS NOT NULL OR folder IS NULL").withColumn("by", F.lit(None).cast(nearest.schema["by"].dataType)).unionByName(
        met.drop("folder_hash"))
    inherited = F.col("origin").isNull() & F.col("by").isNotNull()
    return result.select(
        F.when(F.col("path") != "", F.expr("substring(path, 2)")).alias("path"),
        F.coalesce("found.license", F.when(inherited, F.col("by.license"))).alias("license"),
        F.coalesce("found.cosine", F.when(inherited, F.col("by.cosine"))).alias("cosine"),
        F.coalesce("origin", F.when(inherited, F.lit("inherited"))).alias("origin"),
        F.when(F.col("origin").isNotNull() & (F.col("path") != ""), F.expr("substring(path, 2)"))
        .when(inherited, F.expr("substring(by.path, 2)")).alias("license_path"))
