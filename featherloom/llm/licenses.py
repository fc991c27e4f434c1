"""License scans: MinHash bands of overlapping text windows retrieve templates, exact containment verifies.

Words are runs of bytes other than white space, A-Z in lower case; a shingle is five words in a row. A
template of q shingles belongs to a size class u, the power of two at or above q. For that class a text is
seen as windows of 2u shingles that start every u shingles, so any passage of up to u shingles is whole in a window.

Each of ``bands`` seeds gives one band of one row, the smallest seeded hash of a window or template. A
window that contains 0.8 of a template has a similarity of at least 1/6 to it, so they share a band with
a probability above 1 - (5/6)^bands: 1 - 8e-6 for 64 bands, and 1 - 1e-8 for a whole template.

A window shares a template's band just if the template's smallest shingle lies in it and nothing in the window
hashes lower. Therefore shingles are first looked up among the templates' smallest shingles, and minima are
taken in the windows around those hits only. Every retrieved pair is verified: the share of the template's
distinct shingles that the window holds, as text, must be ``threshold`` or more.

Everything is a DataFrame operation. The look-up set holds at most ``bands`` hashes per template;
templates are taken in blocks so that a block has at most ``BLOCK`` of them. Only hits are shuffled.
Null texts count as empty. A template of fewer than five words is never found. Rows with the same id are
reported as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featherloom.llm.tables import only
from featherloom.llm.url_rules import ascii_lower

WIDTH = 5
BANDS = 64
BLOCK = 500

#: Phrases by which public licenses are named or granted.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def templates_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template_id long, license string, text string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def _hash_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.element_at(words, i + k) for k in range(WIDTH)])


def _shingle_hashes(words: Column) -> Column:
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: _hash_at(words, i))
    return F.when(n >= WIDTH, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def _shingles(words: Column) -> Column:
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.array_join(F.slice(words, i, WIDTH), " "))
    return F.when(n >= WIDTH, F.array_distinct(each)).otherwise(F.expr("cast(array() as array<string>)"))


def find_templates(docs: DataFrame, templates: DataFrame, threshold: float = 0.8, bands: int = BANDS, text: str = "text") -> DataFrame:
    """(doc_id, template_id, license, n_windows, containment, first_word): one row per document and template found in it."""
    known = only(templates, "template_id", "license", "text").filter("text IS NOT NULL").withColumn("words", words_of(F.col("text")))
    known = known.withColumns({"t_hashes": _shingle_hashes(F.col("words")), "t_shingles": _shingles(F.col("words"))}).filter(F.size("t_hashes") > 0)
    known = known.withColumn("u", F.pow(F.lit(2), F.ceil(F.log2(F.size("t_shingles")))).cast("int"))
    seeds = F.sequence(F.lit(1), F.lit(bands))
    marked = known.withColumn("band", F.explode(seeds)).withColumn(
        "mark", F.array_min(F.transform("t_hashes", lambda h, i: F.struct(F.xxhash64(h, F.col("band")).alias("least"), h.alias("hash"), F.element_at("words", i + 1).alias("first_word"))))
    ).select("template_id", "license", "t_shingles", "u", "band", "mark.hash", "mark.first_word")

    out = None
    ids = [r[0] for r in known.select("template_id").distinct().orderBy("template_id").collect()]
    for k in range(0, max(len(ids), 1), BLOCK):
        own = marked.filter(F.col("template_id").isin(ids[k: k + BLOCK])) if ids else marked.filter("false")
        found = _find(docs, own, threshold, text)
        out = found if out is None else out.unionByName(found)
    return out


def _find(docs: DataFrame, marked: DataFrame, threshold: float, text: str) -> DataFrame:
    rows = marked.select("hash", "first_word", "u").distinct().collect()  # at most bands * BLOCK
    wanted, firsts = sorted({r["hash"] for r in rows}), sorted({r["first_word"] for r in rows})
    reach = 2 * max((r["u"] for r in rows), default=1)
    # The bands of a template whose smallest shingle is one hash, together.
    marks = marked.groupBy("hash", "template_id", "license", "t_shingles", "u").agg(F.collect_list("band").alias("bands"))

    def marked_at(words: Column, i: Column) -> Column:
        # The first word rules most places out before anything is hashed.
        return F.element_at(words, i).isin(firsts) & _hash_at(words, i).isin(wanted) if wanted else F.lit(False)

    def around(words: Column, i: Column) -> Column:
        base = F.greatest(i - reach, F.lit(1))
        return F.struct((i - 1).alias("at"), (base - 1).alias("base"), _hash_at(words, i).alias("h"), F.slice(words, base, 2 * reach + WIDTH - 1).alias("near_words"))

    def hits_of(words: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(words) - WIDTH + 1), lambda i: marked_at(words, i))
        return F.when(F.size(words) >= WIDTH, F.transform(at, lambda i: around(words, i)))

    # A lambda variable holds the words of a text, so that they are computed once.
    hits = F.element_at(F.transform(F.array(words_of(F.col(f"`{text}`"))), hits_of), 1)
    # An outer explode: no filter on the hits is derived and computed twice.
    hits = only(docs, "doc_id", text).select("doc_id", F.explode_outer(hits).alias("hit")).filter("hit IS NOT NULL").select("doc_id", "hit.*").withColumn("near", _shingle_hashes(F.col("near_words")))
    near = hits.join(F.broadcast(marks), F.col("h") == F.col("hash"))
    near = near.withColumn("window", F.explode(F.array_distinct(F.array(F.floor(F.col("at") / F.col("u")), F.greatest(F.floor(F.col("at") / F.col("u")) - 1, F.lit(0))))))
    start = (F.col("window") * F.col("u") - F.col("base")).cast("int")
    near = near.withColumn("inside", F.slice("near", start + 1, 2 * F.col("u")))
    shares = F.exists("bands", lambda band: F.array_min(F.transform("inside", lambda x: F.xxhash64(x, band))) == F.xxhash64(F.col("h"), band))
    held = _shingles(F.slice("near_words", start + 1, 2 * F.col("u") + WIDTH - 1))
    checked = near.filter(shares).select(
        "doc_id", "template_id", "license", "window", "u", (F.size(F.array_intersect(held, "t_shingles")) / F.size("t_shingles")).alias("containment")
    ).filter(F.col("containment") >= threshold)
    return checked.groupBy("doc_id", "template_id", "license").agg(
        F.countDistinct("window").alias("n_windows"), F.max("containment").alias("containment"), F.min(F.col("window") * F.col("u")).cast("long").alias("first_word")
    )
