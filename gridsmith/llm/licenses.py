"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Sentences that speak of a license, and the whole texts of licence files, become sparse TF-IDF
vectors; the weights of terms come from all such passages of the corpus. Comment marks go first,
and sentences are taken from lines and from paragraphs with their lines joined, so that a header
wrapped at any column is compared whole. A passage matches the template with the largest cosine
if that reaches ``THRESHOLD``, among the templates whose names and numbers it holds and that have
its variants of a license. A file has
the license of its best passage; an SPDX tag goes before any passage. A file without one inherits
the license of the licence file in the nearest directory above it: each distinct directory is
joined with its ancestors by path.

Texts are read once: passages are written below the checkpoint folder. Equal passages and equal
directories are reduced to one row before they are joined, so a notice in a third of all files
costs one comparison. The templates are a parameter and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import ascii_lower

THRESHOLD = 0.6
# Every text with a passage or tag holds one of these words, in any case.
WORDS = ("licen", "spdx-", "hereby", "redistribution")
# A passage that any license needs to be recognised by.
TRIGGER = r"(?i)licen[cs]e|hereby granted|redistribution and use in source|neither the name of"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]es?|copying|unlicense|notice)(?:[.-][^/]*)?$"
# Marks that open or close the lines of a comment.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+!?|#+!?|;+|--+|%+|<!--+|dnl\b|\.\\\"|\"{3}|'{3})[ \t]*|[ \t]*(?:\*+/|--+>)[ \t]*$"
# A stop before a capital, or a colon before a numbered or marked point.
SENTENCE = r"(?<=[.!?])\s+(?=[\"(]?\p{Lu})|(?<=:)\s+(?=[\p{N}*(-])"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?:\)?[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Za-z0-9][A-Za-z0-9.+-]*)*)"
# "or later" and "only" are one license here.
SPDX_SUFFIX = r"(?:-only|-or-later|\+)(?=[ \t)]|$)"

# The names under which notices refer to a license.
NAMES = [
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache 2.0 License"),
    ("Apache-2.0", "Apache-2.0 License"),
    ("MIT", "MIT License"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "GNU General Public License v3.0"),
    ("GPL-3.0", "GPLv3 License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License v2.0"),
    ("GPL-2.0", "GPLv2 License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
]
# The short notices that name a license.
NOTICES = [
    "{}",
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the {} - see the LICENSE file for details.",
]
# Words of names that tell no license from another.
COMMON = {"the", "license", "version", "v", "international", "public", "general"}
# A passage with one of these words is of a license that has it too.
VARIANTS = ("lesser", "affero")
# Headers, opening sentences and titles by which files declare a license, with the words a passage must hold.
HEADERS = [
    ("Apache-2.0", "apache 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "apache 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MIT", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSL-1.0", "", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "gnu 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "gnu 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."),
    ("GPL-2.0", "gnu 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "gnu lesser 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "gnu lesser 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "gnu lesser 3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "gnu affero 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "gnu affero 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "neither endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
# The opening that several licenses share: it counts if no passage of the file says more.
SHARED_OPENING = "BSD-2-Clause"


def notices() -> list[tuple[str, str, str]]:
    """(license, words a passage must hold, text) of the headers, and of every notice with every name."""
    found = list(HEADERS)
    for license, name in NAMES:
        words = [w.strip(",.").lower() for w in name.split()]
        needed = " ".join(w for w in words if w not in COMMON)
        found += [(license, needed, form.format(name)) for form in NOTICES]
    return found


def _terms(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[^\p{L}\p{N}.+-]+|[.]+(?=\s|$)"), lambda w: w != "")


def _spoken(text: Column) -> Column:
    """Sentences with a trigger, of the lines and of the paragraphs of a text."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), COMMENT, "")
    sentences = lambda parts: F.flatten(F.transform(parts, lambda p: F.split(p, SENTENCE)))
    of_lines = sentences(F.filter(F.split(bare, r"\n+"), lambda p: p.rlike(TRIGGER)))
    joined = F.transform(F.split(bare, r"\n[ \t]*\n\s*"), lambda p: F.regexp_replace(p, r"\s+", " "))
    of_paragraphs = sentences(F.filter(joined, lambda p: p.rlike(TRIGGER)))
    trimmed = F.transform(F.concat(of_lines, of_paragraphs), lambda s: F.trim(s))
    return F.filter(F.array_distinct(trimmed), lambda s: s.rlike(TRIGGER) & ~s.contains("SPDX-License-Identifier"))


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str, str]] | None = None,
    threshold: float = THRESHOLD, keep_text: bool = True,
) -> DataFrame:
    """Add ``license``, ``similarity`` and ``origin`` (own, inherited, null) to every row.

    A licence file is one with such a name, or one whose whole text is a single passage. A null
    text has no passage; a null path neither gives nor inherits. Of equally similar templates
    the first by name is taken, of several licence files in a directory the best match. The first
    SPDX tag of a text is its license with similarity 1, also an identifier without a template;
    "only" and "or later" are dropped from it. The opening that BSD licenses share gives
    BSD-2-Clause unless another passage of the file matches. Columns of ``files`` with the names
    of results are replaced; all rows stay. ``keep_text=False`` drops the text, which is then
    not written with the passages. ``templates`` are (license, needed words, text).
    """
    templates = notices() if templates is None else templates
    files = files.drop("license", "similarity", "origin")
    spark = files.sparkSession
    kept = [c for c in files.columns if keep_text or c != text]
    directory = F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1)
    files = files.withColumn("__dir", F.when(F.col(path).isNotNull(), directory))
    named = F.coalesce(F.col(path).rlike(LICENCE_FILE), F.lit(False))
    lowered, holds = F.lower(F.col(text)), F.lit(False)
    for word in WORDS:
        holds = holds | lowered.contains(word)
    none = F.array().cast("array<string>")
    whole = F.when(named, F.array(F.trim(F.col(text)))).otherwise(none)
    passages = F.array_distinct(F.concat(_spoken(F.col(text)), whole))
    tag = F.regexp_replace(F.regexp_extract(F.col(text), SPDX, 1), SPDX_SUFFIX, "")
    files = files.withColumns({
        "__passages": F.when(holds, passages).otherwise(none),
        "__tag": F.when(holds & (tag != ""), tag),
        "__trimmed": F.when(holds, F.trim(F.col(text))),
    })
    single = (F.size("__passages") == 1) & (F.col("__trimmed") == F.try_element_at("__passages", F.lit(1)))
    files = files.withColumn("__file", named | F.coalesce(single, F.lit(False))).drop("__trimmed")
    files = cut_lineage(files if keep_text else files.drop(text))

    counted = files.select(F.explode("__passages").alias("passage")).groupBy("passage").agg(F.count("*").alias("n"))
    terms = counted.select("passage", "n", F.explode(_terms(F.col("passage"))).alias("term"))
    terms = terms.groupBy("passage", "n", "term").agg(F.count("*").alias("tf"))
    model = spark.createDataFrame(
        [(i, name, sorted(set(needed.split())), body) for i, (name, needed, body) in enumerate(templates)],
        "template int, name string, needed array<string>, body string",
    )
    wanted = model.select("template", "name", "needed", F.explode(_terms(F.col("body"))).alias("term"))
    wanted = wanted.groupBy("template", "name", "needed", "term").agg(F.count("*").alias("tf"))
    # The templates count as passages, so each of their terms has a weight on any corpus.
    seen = terms.select("term", "n").unionByName(wanted.select("term", F.lit(1).cast("bigint").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)) + len(templates)).first()[0]
    seen = seen.select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = terms.join(seen, "term").select("passage", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    ideal = wanted.join(seen, "term").select(
        "template", "name", "term", ((1 + F.log("tf")) * F.col("idf")).alias("v"),
        F.size("needed").alias("needed"), F.array_contains("needed", F.col("term")).cast("int").alias("names"),
        F.col("term").isin(*VARIANTS).cast("int").alias("variant"),
    )
    lengths = weighed.groupBy("passage").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("a"), F.sum(F.col("term").isin(*VARIANTS).cast("int")).alias("variants")
    )
    ideal_lengths = ideal.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("b"))
    dots = weighed.join(ideal, "term").groupBy("passage", "template", "name", "needed").agg(
        F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum("names").alias("names"), F.sum("variant").alias("variant")
    ).where(F.col("names") == F.col("needed"))
    cosine = (
        dots.join(lengths, "passage")
        .where(F.col("variant") == F.col("variants"))
        .join(ideal_lengths, "template")
        .select("passage", "name", F.round(F.col("dot") / (F.col("a") * F.col("b")), 9).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    match = cosine.groupBy("passage").agg(F.max("similarity").alias("similarity"), F.min_by("name", F.struct(-F.col("similarity"), "name")).alias("license"))

    # Files without passages match nothing and are spread by their paths.
    keyed = files.withColumn("__row", F.when(F.size("__passages") > 0, F.xxhash64("__passages")).otherwise(F.xxhash64(F.col(path))))
    # Files with the same passages share one answer.
    sets = keyed.where(F.size("__passages") > 0).select("__row", "__passages").groupBy("__row", "__passages").agg(F.lit(1).alias("one"))
    own = (
        sets.select("__row", "__passages", F.explode("__passages").alias("passage"))
        .join(match, "passage")
        .groupBy("__row", "__passages")
        .agg(F.min_by(F.struct("license", "similarity"), F.struct(F.col("license") == SHARED_OPENING, -F.col("similarity"), "license")).alias("__best"))
    )
    files = keyed.join(own, ["__row", "__passages"], "left")
    files = files.withColumns({
        "__own": F.coalesce("__tag", "__best.license"),
        "__similarity": F.when(F.col("__tag").isNotNull(), 1.0).otherwise(F.col("__best.similarity")),
    })
    granted = files.where("__file AND __own IS NOT NULL AND __dir IS NOT NULL").groupBy(F.col("__dir").alias("ancestor")).agg(
        F.min_by(F.struct(F.col("__own").alias("license"), F.col("__similarity").alias("similarity")), F.struct(-F.col("__similarity"), "__own")).alias("given")
    )
    steps = F.split("__dir", "/")
    above = files.where("__dir IS NOT NULL").groupBy("__dir").agg(F.lit(1).alias("one")).select(
        "__dir",
        F.explode(
            F.concat(
                F.array(F.lit("")),
                F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")),
            )
        ).alias("ancestor"),
    )
    inherited = above.join(granted, "ancestor").groupBy("__dir").agg(F.max_by("given", F.length("ancestor")).alias("__given"))
    files = files.join(inherited, "__dir", "left")
    return files.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce("__own", "__given.license").alias("license"),
        F.coalesce("__similarity", "__given.similarity").alias("similarity"),
        F.when(F.col("__own").isNotNull(), "own").when(F.col("__given").isNotNull(), "inherited").alias("origin"),
    )
