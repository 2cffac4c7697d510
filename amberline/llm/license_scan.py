"""Licence scan: sparse TF-IDF cosine of notice lines and licence files to templates, then inheritance by directories.

Everything is joins and grouped sums. A file's own licence is that of the template closest to one of its notice lines
(lines that name a licence or a right) or to a paragraph that has one, or, for a licence file, to its whole text, which
is compared with whole licences too. An SPDX identifier tells a licence by itself. A file without one inherits from the
licence files of its nearest ancestor directory.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import materialise
from amberline.llm.decontaminate import let
from amberline.llm.license_texts import TEXTS

#: Short notices and the opening words of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0)"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
]
NOTICE = r"(?i)licen[cs]e|copyright|permission|redistribut|public domain|rights reserved|free software|spdx"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)[^/]*$"
#: Paragraphs are parted by lines without letters and digits, so comment signs do not hide the gaps.
GAP = r"\n[^\p{L}\p{N}\n]*\n"
#: One identifier; of alternatives the first. Several that hold together are not one licence.
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)(?![A-Za-z0-9.+-])(?![^\n]* AND )"
LEAST_COSINE = 0.6
#: Scores are rounded to this many digits before they are compared, so that the order of sums does not matter.
DIGITS = 9


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; dots and hyphens between them part words."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def counted_terms(text: Column) -> Column:
    """A struct (term, tf) for each different token of a text: its hash and how often it is there. Equal tokens stand side
    by side once sorted, so nothing is shuffled to count them."""

    def runs(hashes: Column) -> Column:
        n = F.size(hashes)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(hashes, i) != F.get(hashes, i - 1)))
        counted = let(starts, lambda s: F.transform(s, lambda at, i: F.struct(F.get(hashes, at).alias("term"), (F.coalesce(F.get(s, i + 1), n) - at).alias("tf"))))
        return F.when(n > 0, counted).otherwise(F.array().cast("array<struct<term:bigint,tf:int>>"))

    return let(F.sort_array(F.transform(tokens(text), lambda w: F.xxhash64(w))), runs)


def templates(spark) -> DataFrame:
    """The parameter table of templates: its size does not depend on the data."""
    every = [(name, text, False) for name, text in TEMPLATES] + [(name, text, True) for name, text in sorted(TEXTS.items())]
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}', {full})" for i, (name, text, full) in enumerate(every))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, licence, text, full)")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = LEAST_COSINE, all_words: bool = False) -> DataFrame:
    """path, licence, score, basis (notice, file, inherited or none), origin (the path that the licence comes from) and
    margin (how much the cosine is above that of the next licence; null for identifiers).

    Weights are term counts times log((1 + n) / (1 + n with the term)) + 1. With `all_words` the n are the different
    pieces that are compared, and every word of them is counted. Without it the n are the files, only words that a
    template has are counted, any other weighs as if no file had it, and for notices only the short templates' words are.
    Notices are compared with the short templates, licence files with whole licences too; what the whole text of a licence
    file says comes before what its notices say. The best template is the one of highest cosine, at least `least`, then
    of the smaller licence name; an SPDX identifier of a licence that has a template scores 1. A null or empty text has
    no licence of its own; a null path has no directory and inherits nothing. Rows that repeat a path are one file: it
    has the best licence that any of them has, and each row gets it. Very long texts are compared as a whole too. Columns
    besides path and text take no part, whatever their names. An empty table gives no rows.
    """
    spark = files.sparkSession
    files = files.select(F.col(path_col).cast("string").alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Bounded by the templates alone, whatever the data.
    terms = materialise(templates(spark).select("template", "licence", "full", F.explode(counted_terms(F.col("text"))).alias("t")).select("template", "licence", "full", "t.term", "t.tf"), "terms")

    # A licence file is compared as a whole; of every file, its notice lines and the paragraphs that have one are.
    is_licence = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    piece = lambda x, whole: F.struct(F.lit(whole).alias("whole"), x.alias("piece"))
    notices = F.transform(F.array_distinct(F.filter(F.concat(F.split("text", "\n"), F.split("text", GAP)), lambda x: x.rlike(NOTICE))), lambda x: piece(x, False))
    none = F.array().cast("array<struct<whole:boolean,piece:string>>")
    cut = F.concat(F.when(is_licence, F.array(piece(F.col("text"), True))).otherwise(none), F.when(F.col("text").rlike(NOTICE), notices).otherwise(none))
    pieces = files.select("path", is_licence.alias("is_licence"), F.explode(cut).alias("p")).select("path", "is_licence", "p.whole", "p.piece").where(F.col("piece") != "")
    # Equal pieces are compared once, however many files hold them. They get numbers, which the written table fixes.
    key = [F.xxhash64("piece").alias("k1"), F.xxhash64("piece", F.lit(1)).alias("k2")]
    keyed = pieces.select("path", "is_licence", "whole", *key, "piece")
    distinct = materialise(keyed.groupBy("whole", "k1", "k2").agg(F.first("piece").alias("piece")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    counts = distinct.select("id", "whole", F.explode(counted_terms(F.col("piece"))).alias("t")).select("id", "whole", "t.term", "t.tf")

    vocabulary = terms.groupBy("term").agg((~F.min("full")).alias("short"))
    if all_words:
        # A word of a piece is in one piece at least, so only those of several are kept.
        n = distinct.where(F.size(tokens(F.col("piece"))) > 0).count()
        df = materialise(counts.groupBy("term").agg(F.count("*").alias("df")).where("df > 1"), "df")
        weight = lambda df: F.log((1.0 + n) / (1 + df)) + 1
        # A template's word may be in no piece or in one: these few are told by looking for them.
        one = counts.join(F.broadcast(vocabulary.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        idf = materialise(vocabulary.join(one, "term", "left").select("term", weight(F.coalesce("df", F.lit(0))).alias("idf")), "idf")
        # The frequencies grow with the files: no broadcast is asked for.
        weighed = counts.join(df, "term", "left").select("id", "whole", "term", (F.col("tf") * weight(F.coalesce("df", F.lit(1)))).alias("w"))
    else:
        # Statistics over all files, of the words that the templates have.
        of_file = files.select(F.explode(F.transform(F.array_distinct(tokens(F.col("text"))), lambda w: F.xxhash64(w))).alias("term"))
        found = of_file.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        n = files.count()
        idf = materialise(vocabulary.join(found, "term", "left").select("term", "short", (F.log((1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")), "idf")
        rarest = F.lit(math.log(1 + n) + 1)
        weighed = counts.join(F.broadcast(idf), "term", "left").select("id", "whole", "term", (F.col("tf") * F.coalesce(F.when(F.col("whole") | F.col("short"), F.col("idf")), rarest)).alias("w"))

    weights = terms.join(idf, "term").select("template", "licence", "full", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = materialise(weights.join(norms, "template").select("template", "full", "term", (F.col("w") / F.col("norm")).alias("tw")), "weights")
    # For each word all its weights at once: a word is looked up once. Template -1 stands for the piece's own length.
    by_term = weights.groupBy("term").agg(F.collect_list(F.struct("template", "full", "tw")).alias("tws"))
    parts = weighed.join(F.broadcast(by_term), "term", "left")
    own = F.array(F.struct(F.lit(-1).alias("template"), (F.col("w") * F.col("w")).alias("x")))
    dots = F.transform(F.filter("tws", lambda t: F.col("whole") | ~t["full"]), lambda t: F.struct(t["template"].alias("template"), (F.col("w") * t["tw"]).alias("x")))
    sums = parts.select("id", F.explode(F.concat(own, F.coalesce(dots, F.array().cast("array<struct<template:int,x:double>>")))).alias("p")).groupBy("id", "p.template").agg(F.sum("p.x").alias("x"))
    # As many entries as there are templates.
    of_id = sums.groupBy("id").agg(F.max(F.when(F.col("template") < 0, F.sqrt("x"))).alias("length"), F.collect_list(F.when(F.col("template") >= 0, F.struct("template", "x"))).alias("dots"))
    names_of = F.broadcast(terms.select("template", "licence").distinct())
    scored = of_id.select("id", "length", F.explode("dots").alias("d")).select("id", "d.template", F.round(F.col("d.x") / F.col("length"), DIGITS).alias("score")).join(names_of, "template")
    near = scored.groupBy("id", "licence").agg(F.max("score").alias("score")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "licence"))).alias("near"))
    first, second = F.col("near")[0], F.get("near", F.lit(1))
    of_piece = near.where(-first["minus"] >= least).select("id", first["licence"].alias("licence"), (-first["minus"]).alias("score"), F.round(F.coalesce(second["minus"], F.lit(0.0)) - first["minus"], DIGITS).alias("margin"))
    of_piece = materialise(of_piece.join(distinct.select("id", "whole", "k1", "k2"), "id").drop("id"), "pieces")
    best = lambda by: F.min(F.struct(*by, (-F.col("score")).alias("minus"), "licence", "margin")).alias("best")

    named = F.regexp_replace(F.regexp_extract("text", SPDX, 1), r"(-only|-or-later|\+)$", "")
    names = sorted({name for name, _ in TEMPLATES if name != "proprietary"} | TEXTS.keys())
    told = files.where(F.col("text").contains("SPDX-License-Identifier:")).select("path", is_licence.alias("is_licence"), F.lit(True).alias("whole"), named.alias("licence"), F.lit(1.0).alias("score"), F.lit(None).cast("double").alias("margin")).where(F.col("licence").isin(names))
    own = keyed.select("path", "is_licence", "whole", "k1", "k2").join(of_piece, ["whole", "k1", "k2"]).select("path", "is_licence", "whole", "licence", "score", "margin").unionByName(told)
    own = own.groupBy("path", "is_licence").agg(best([(~F.col("whole")).alias("part")]))
    own = materialise(own.select("path", "is_licence", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"), F.col("best.margin").alias("margin")), "own")

    # The best licence of each directory that holds licence files, then each file's ancestors, nearest first.
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    directories = own.where("is_licence").select(directory.alias("directory"), "licence", "score", "margin", "path").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence", "path", "margin")).alias("best"))
    directories = materialise(directories.select("directory", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("score"), F.col("best.margin").alias("margin"), F.col("best.path").alias("origin")), "directories")
    paths = files.select("path")
    without = paths.where(F.col("path").isNotNull()).distinct().join(own.select("path"), "path", "left_anti")
    parts = F.split(directory, "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("directory")))
    above = without.select("path", F.explode(ancestors).alias("a")).select("path", "a.depth", "a.directory").distinct()
    nearest = above.join(directories, "directory").groupBy("path").agg(F.max(F.struct("depth", "licence", "score", "margin", "origin")).alias("up"))
    inherited = nearest.select("path", F.col("up.licence").alias("licence"), F.col("up.score").alias("score"), F.lit("inherited").alias("basis"), F.col("up.origin").alias("origin"), F.col("up.margin").alias("margin"))
    told = own.select("path", "licence", "score", F.when(F.col("is_licence"), "file").otherwise("notice").alias("basis"), F.col("path").alias("origin"), "margin").unionByName(inherited)
    told = materialise(told, "licences")
    out = paths.alias("f").join(told.alias("t"), F.col("f.path").eqNullSafe(F.col("t.path")), "left")
    return out.select("f.path", "licence", "score", F.coalesce("basis", F.lit("none")).alias("basis"), "origin", "margin")
