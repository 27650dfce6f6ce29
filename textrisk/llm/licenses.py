"""Licences of files: TF-IDF cosine of their notices to templates, and inheritance by directory.

A file's notices are the lines that speak of a licence.  Each is compared with
the templates as a sparse TF-IDF vector; the best match is the file's own
licence.  A file without one takes that of the nearest directory above it that
holds a licence file.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrisk.llm.common import compact, sized

#: Cosine from which a notice has the licence of a template.
COSINE = 0.6
#: Share of a file's characters in notices from which it is a licence file.
NOTICE_SHARE = 0.4

# Notices of public licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright; released under CC0 1.0 into the public domain."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_CUE = r"(?i)licen[cs]|copyright|permission|redistribut|public domain|spdx"
_TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
_LICENCE_NAME = r"(?i)^(un)?licen[cs]es?(\..*)?$|^copying(\..*)?$|^notice(\..*)?$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf) of rows with ``line``."""
    return rows.select(*keys, F.explode(_terms(F.col("line"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def notices(files: DataFrame, templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(file, line_no, length, license, cosine): lines of (file, text) with the licence they come closest to.

    The document frequency of a term counts all notices and all templates.
    Equal lines are compared once, however many files hold them; of equal
    cosines the licence first in the alphabet is taken.
    """
    spark = files.sparkSession
    speaking = files.where(F.col("text").rlike(_CUE))
    lines = compact(
        speaking.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(_CUE)), "notices"
    )
    distinct = lines.table.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(i, name, line) for i, (name, line) in enumerate(templates)], "template int, license string, line string")
    of_lines = _counted(distinct, "line", "n")
    of_templates = _counted(known, "template", "license")
    frequency = of_lines.select("term", "n").unionByName(of_templates.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    total = lines.table.count() + len(templates)
    idf = frequency.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    weigh = lambda counted: counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    line_terms = compact(weigh(of_lines).select("line", "term", "w"), "weights").table
    template_terms = weigh(of_templates).select("template", "license", "term", "w")
    lengths = line_terms.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    template_norms = template_terms.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    small = sized(template_terms.withColumnRenamed("w", "t_w"), sum(200 * len(line) for _, line in templates))
    dots = line_terms.join(small, "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    best = (
        dots.join(sized(template_norms, 64 * len(templates)), "template")
        .join(lengths, "line")
        .withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 9))
        .groupBy("line")
        .agg(F.min(F.struct(F.negative("cosine").alias("minus"), "license")).alias("b"))
        .select("line", "b.license", F.negative("b.minus").alias("cosine"))
        .where(F.col("cosine") >= cosine)
    )
    return lines.table.join(best, "line").select("file", "line_no", F.length("line").alias("length"), "license", "cosine")


def _parent(path: Column) -> Column:
    """Directory of a path; the root is empty."""
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """One row per path: (path, license, cosine, origin, from_directory).

    ``origin`` is ``own`` where the file holds a notice, ``inherited`` where a
    directory above it has a licence file, else null.  A licence file is one with
    such a name or with NOTICE_SHARE of its characters in notices.  Of several
    licences of a file or of a directory the one with the highest cosine holds, of
    equal ones the first in the alphabet.  Null texts hold nothing, a null path
    stays out; rows that repeat a path are one file with all their notices.

    Directories are made distinct before they are expanded to those above them,
    so a directory with a third of all files is expanded once.
    """
    named = files.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("file"), F.col(text).alias("text"))
    found = compact(notices(named, templates, cosine), "licences").table
    best = F.min(F.struct(F.negative("cosine").alias("minus"), "license")).alias("b")
    own = found.groupBy("file").agg(best, F.sum("length").alias("in_notices")).select(
        "file", "b.license", F.negative("b.minus").alias("cosine"), "in_notices"
    )
    sizes = named.select("file", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), _parent(F.col("file")).alias("directory"))
    every = sizes.groupBy("file", "directory").agg(F.sum("n_chars").alias("n_chars"))
    judged = every.join(own, "file", "left")
    base = F.element_at(F.split("file", "/"), -1)
    is_licence = F.col("license").isNotNull() & (base.rlike(_LICENCE_NAME) | (F.col("in_notices") >= F.col("n_chars") * NOTICE_SHARE))
    holders = compact(
        judged.where(is_licence).groupBy("directory").agg(best).select(
            F.col("directory").alias("holder"), F.col("b.license").alias("inherited"), F.negative("b.minus").alias("inherited_cosine")
        ),
        "licence-directories",
    ).table
    parts = F.split("directory", "/")
    above = every.select("directory").distinct().select(
        "directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")
    ).select(
        "directory", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("holder")
    )
    size = holders.agg(F.sum(F.octet_length("holder") + 64).alias("n")).first().n or 0
    nearest = (
        above.join(sized(holders, size), "holder")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "holder", "inherited", "inherited_cosine")).alias("s"))
        .select("directory", "s.holder", "s.inherited", "s.inherited_cosine")
    )
    own_one = F.col("license").isNotNull()
    return judged.join(nearest, "directory", "left").select(
        F.col("file").alias(path),
        F.when(own_one, F.col("license")).otherwise(F.col("inherited")).alias("license"),
        F.when(own_one, F.col("cosine")).otherwise(F.col("inherited_cosine")).alias("cosine"),
        F.when(own_one, "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"),
        F.when(own_one, F.col("directory")).otherwise(F.col("holder")).alias("from_directory"),
    )
