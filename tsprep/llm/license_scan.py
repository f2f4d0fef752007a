"""Licence notices in documents, on DataFrame functions alone.

Templates and texts are cut into overlapping windows of four five-word shingles, one window at each
word. A window's MinHash signature has ``BANDS`` entries, each a band of its own: of the window's
shingles, the smallest under one permutation of their hashes. A text and a template that share a band
are a candidate, and the template's shingles are then counted in the whole text.

Two equal windows share all bands, so a notice that keeps four shingles (eight words) in a row is
always met. Windows with one shingle in common share a band with a probability of at least 1/7, so six
shingles that all stand apart are missed with a probability below (6/7) ** (6 * BANDS), which is 0.03.
Templates of fewer than ``LONG`` shingles are looked for by windows of one shingle, where a band is
the shingle itself and every common shingle is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsprep.llm.common import id_and_text, whole_text
from tsprep.session import keep

SHINGLE = 5
#: Shingles in a window.
WINDOW = 4
BANDS = 4
#: Templates of at least so many shingles are looked for by windows of several shingles.
LONG = 8
PERCENT = 75
#: Exclusive or with each permutes the order of hashes.
MASKS = [0x1B873593A5C96F21, 0x5E2D58D8B3BCDEF7, -0x3A9D1E64C2F0B58B, -0x71C4E9A86D3B1F05]

# The notices that are looked for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z); whatever is neither an ASCII letter or digit nor beyond ASCII separates."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.split(F.translate(text, upper, lower), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+")
    return F.filter(parts, lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Distinct runs of five words, as text."""
    last = F.size(words) - (SHINGLE - 1)
    runs = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(SHINGLE)))
    )
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def hashes_of(words: Column) -> Column:
    """A number for each run of five words, in the order of the text."""
    firsts = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    runs = F.transform(firsts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))


def band(hashes: Column, mask: int) -> Column:
    """The smallest hash of each window under one permutation; a short text is one window."""
    firsts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WINDOW, F.lit(0)))
    window = lambda i: F.least(*(F.get(hashes, i + k).bitwiseXOR(F.lit(mask)) for k in range(WINDOW)))
    return F.array_distinct(F.filter(F.transform(firsts, window), F.isnotnull))


def keys_of(hashed: DataFrame, long: Column, short: Column) -> DataFrame:
    """A row for each distinct ``band, key`` of a row with ``hashes``: of its long windows, its short ones."""
    nothing = F.array().cast("array<bigint>")
    bands = [F.when(long, band(F.col("hashes"), mask)).otherwise(nothing) for mask in MASKS[:BANDS]]
    bands.append(F.when(short, F.array_distinct("hashes")).otherwise(nothing))
    others = [c for c in hashed.columns if c != "hashes"]
    # no filter on the hashes here: pushed to the scan, it would split the text anew at each word
    each = hashed.select(*others, F.posexplode(F.array(*bands)).alias("band", "ks"))
    return each.select(*others, "band", F.explode("ks").alias("key"))


def template_shingles(spark: SparkSession, templates: DataFrame | dict[str, str]) -> DataFrame:
    """``license, hashes, t_shingles`` of every template of five words or more."""
    if isinstance(templates, dict):
        templates = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    rows = templates.select("license", words_of(whole_text("body")).alias("words"))
    return rows.where(F.size("words") >= SHINGLE).select(
        "license", hashes_of(F.col("words")).alias("hashes"), shingles_of(F.col("words")).alias("t_shingles")
    )


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame | dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """One row per document and licence found: ``doc_id, license, shared, shingles, containment``.

    ``templates`` is a table of ``license, body`` with texts of any number and length, or a dictionary.
    A notice is found where the text holds at least ``percent`` of the template's distinct
    five-word shingles, wherever they are. Templates of fewer than five words are never found, a
    licence with several bodies has a row for each that differs in size.
    NULL and short texts hold nothing. Rows that share an id count as one document.

    Whether candidates and templates travel to the texts or are shuffled with them, Spark decides by
    the sizes of the tables written here.
    """
    spark = docs.sparkSession
    made = template_shingles(spark, TEMPLATES if templates is None else templates).select(
        "*", F.xxhash64("license", "t_shingles").alias("t")
    )
    made = keep(made.dropDuplicates(["t"]))
    is_long = F.size("t_shingles") >= LONG
    asked = keep(keys_of(made.select("t", "t_shingles", "hashes"), is_long, ~is_long).select("t", "band", "key"))

    texts = id_and_text(docs, id_col, text_col)
    words = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", hashes_of(F.col("words")).alias("hashes"))
    met = keys_of(hashed, F.lit(True), F.lit(True)).join(asked, ["band", "key"])
    met = keep(met.select(F.col("doc_id").alias("id"), "t").distinct())

    near = texts.join(met, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "t", words_of(F.col("text")).alias("words"))
    near = near.select("doc_id", "t", shingles_of(F.col("words")).alias("held"))
    found = near.join(made.select("t", "license", "t_shingles"), "t").select(
        "doc_id",
        "license",
        "t",
        F.size("t_shingles").cast("bigint").alias("shingles"),
        F.size(F.array_intersect("t_shingles", "held")).cast("bigint").alias("shared"),
    ).where((F.col("shared") > 0) & (F.col("shared") * 100 >= F.col("shingles") * percent))
    best = found.groupBy("doc_id", "license", "t", "shingles").agg(F.max("shared").alias("shared"))
    return best.select(
        "doc_id", "license", "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment")
    )


def oracle_sql(templates: dict[str, str]) -> str:
    """The same rows by looking for every shingle in every whole text."""
    values = ", ".join(
        "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items())
    )
    plain = (
        "trim(regexp_replace(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'))"
    )
    return f"""
WITH t AS (SELECT license, string_split({plain.format('body')}, ' ') AS w
           FROM (VALUES {values}) AS v(license, body)),
s AS (SELECT DISTINCT license, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS shingle
      FROM (SELECT license, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
n AS (SELECT license, count(*) AS shingles FROM s GROUP BY license),
d AS (SELECT doc_id, ' ' || {plain.format('text')} || ' ' AS words FROM documents),
f AS (SELECT doc_id, license, count(*) AS shared
      FROM d JOIN s ON contains(d.words, ' ' || s.shingle || ' ') GROUP BY doc_id, license)
SELECT doc_id, license, shared, shingles, shared / shingles AS containment
FROM f JOIN n USING (license) WHERE shared * 100 >= shingles * {PERCENT}"""
