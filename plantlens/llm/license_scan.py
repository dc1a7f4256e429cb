"""Licence notices: lines and paragraphs against templates by Dice coefficient over word bigrams, all in column functions.

2 |A and B| / (|A| + |B|) >= t needs |A| between |B| t / (2 - t) and |B| (2 - t) / t, so each template is listed under the sizes that
can reach t, and a unit of text meets only the templates under its own size (an equality join with a small table).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import query, table

THRESHOLD = 0.7
#: Short notices as they stand in texts and file headers. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
]
SEPARATORS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Normalised words: lower case, everything but letters and digits separates."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct word bigrams; a single word has none."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
    return F.when(F.size(w) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def size_range(n: int, threshold: float) -> range:
    """Sizes of bigram sets whose Dice coefficient with a set of ``n`` can reach the threshold."""
    return range(math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


def template_table(spark, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """license_id, template (its number), t_grams and each size it can match. The list of templates is a parameter, so its size is known."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license_id string, text string")
    rows = rows.withColumn("t_grams", bigrams(words(F.col("text")))).withColumn("n", F.size("t_grams"))
    low, high = F.ceil(F.col("n") * (threshold / (2 - threshold)) - 1e-9), F.floor(F.col("n") * ((2 - threshold) / threshold) + 1e-9)
    return rows.where("n > 0").select("template", "license_id", "t_grams", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (doc_id, unit, place, license_id, template, dice) per unit of a text and template that reach ``threshold``.

    Units are lines (by line number) and paragraphs of several lines (by number of the paragraph; empty lines separate them). Whole
    texts are read. NULL, empty and wordless texts match nothing; repeated rows give repeated matches; of several templates that match
    a unit all are returned; an empty table gives no rows; no column but id and text is read. Nothing is shuffled.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates, threshold)
    most = known.agg(F.max("size")).first()[0] or 0
    text = F.col(text_column)
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), x.alias("part")))
    paragraphs = F.transform(F.split(text, r"\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("place"), x.alias("part")))
    units = F.concat(lines, F.filter(paragraphs, lambda p: F.instr(p["part"], "\n") > 0))
    # Each distinct word but the last begins a bigram of its own, so a unit of more distinct words has more bigrams than any template allows for.
    parts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.explode(units).alias("u")).select("doc_id", "u.*")
    parts = parts.withColumn("w", words(F.col("part"))).where((F.size("w") >= 2) & (F.size(F.array_distinct("w")) <= most + 1))
    parts = parts.withColumn("grams", bigrams(F.col("w"))).withColumn("size", F.size("grams"))
    met = parts.join(F.broadcast(known), "size")
    shared = F.size(F.array_intersect("grams", "t_grams"))
    dice = 2.0 * shared / (F.col("size") + F.size("t_grams"))
    return met.select("doc_id", "unit", F.col("place").cast("long").alias("place"), "license_id", F.col("template").cast("long").alias("template"), dice.alias("dice")).where(F.col("dice") >= threshold)


def _sql() -> str:
    quoted = ", ".join(f"({i}, '{n}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (n, t) in enumerate(TEMPLATES))
    w = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = lambda c: f"list_distinct(list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1]))"
    return f"""WITH t AS (SELECT template, license_id, {grams('w')} AS t_grams FROM (SELECT *, {w('text')} AS w FROM (VALUES {quoted}) AS v(template, license_id, text))),
      l AS (SELECT doc_id, 'line' AS unit, unnest(range(len(s))) AS place, unnest(s) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
      p AS (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(s))) AS place, unnest(s) AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS s FROM documents)),
      u AS (SELECT *, {w('part')} AS w FROM (SELECT * FROM l UNION ALL SELECT * FROM p WHERE contains(part, chr(10)))),
      g AS (SELECT *, {grams('w')} AS grams FROM u WHERE len(w) >= 2)
      SELECT doc_id, unit, place::BIGINT AS place, license_id, template::BIGINT AS template,
        2.0::DOUBLE * len(list_intersect(grams, t_grams)) / (len(grams) + len(t_grams)) AS dice
      FROM g, t WHERE 2.0::DOUBLE * len(list_intersect(grams, t_grams)) / (len(grams) + len(t_grams)) >= {THRESHOLD}"""


@query(_sql())
def op4_license_scan(spark, sf):
    return license_matches(table(spark, sf, "documents"))
