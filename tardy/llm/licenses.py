"""License scan by MinHash bands over overlapping text windows, in DataFrame functions.

Every window of ``WINDOW`` words of a document is a set of word pairs with one
MinHash value for each band; the templates' windows are hashed alike, and a
document window that shares a band's value retrieves the template.  It counts
only if a stretch of words around the window, a fifth longer than the template,
contains the template's word pairs to ``containment`` exactly, and among them
every pair with a number in it: a version tells licenses apart that share the
rest of their words.

Band settings: a window that holds at least two of a template window's three
pairs has Jaccard similarity 1/2 or more with it, so ``band_count`` bands of
one row miss it with probability (1/2) ** bands at most; an unaltered stretch
of ``WINDOW`` words equals a template window and is never missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tardy.session import materialize

WINDOW = 4

#: license notices (fixed values; a parameter of ``scan_licenses``)
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                       "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0-text": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
}

_NOT_WORD = r"[^a-z0-9\u0080-\uFFFF]+"


def band_count(similarity: float = 0.5, miss: float = 1e-4) -> int:
    """Bands of one row such that a window of that similarity is missed with
    probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def license_words(text: Column) -> Column:
    """Lower-cased words of letters and digits (null: none)."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), lambda w: w != "")


def _zipped(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n).alias("l"), F.slice(words, 2, n).alias("r"))


def _hashes(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.xxhash64(p["l"], p["r"]))


def _windows(rows: DataFrame, keys: list[str], words: str) -> DataFrame:
    """(keys, i, g0..): place of every window of ``WINDOW`` words and hashes of
    its pairs (null past the end of a text with fewer words)."""
    w = F.col(words)
    last = F.greatest(F.size(w) - (WINDOW - 1), F.least(F.size(w) - 1, F.lit(1)))
    shifted = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(last, F.lit(0))).alias(f"w{i}") for i in range(WINDOW)])
    one = rows.select(*keys, F.posexplode(shifted).alias("i", "x"))
    return one.select(*keys, "i", *[F.when(F.col(f"x.w{i + 1}").isNotNull(), F.xxhash64(f"x.w{i}", f"x.w{i + 1}")).alias(f"g{i}") for i in range(WINDOW - 1)])


def _bands(windows: DataFrame, keys: list[str], bands: int) -> DataFrame:
    """(keys, value): the least hash of a window's pairs for each band, a row
    each; the band is part of the hash, so a value belongs to one band.  (All
    bands of a window in one row make generated code too long to compile.)"""
    each = windows.select(*keys, *[f"g{i}" for i in range(WINDOW - 1)], F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return each.select(*keys, F.least(*[F.when(F.col(f"g{i}").isNotNull(), F.xxhash64(f"g{i}", "band")) for i in range(WINDOW - 1)]).alias("value"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
                  containment: float = 0.8, miss: float = 1e-4) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_licenses, licenses`` (array of
    template names, sorted).

    A template of m words matches when m + m div 5 neighbouring words of
    the document hold at least ``containment`` of the template's distinct word
    pairs, and all of those with a digit.  Templates need two words.
    Null and empty texts, and texts of one word, match nothing; rows that
    repeat are each reported; an empty table gives an empty result.  Other
    columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    bands = band_count(miss=miss)
    known = spark.createDataFrame(sorted(templates.items()), "license string, t string").select("license", license_words(F.col("t")).alias("w")).where(F.size("w") > 1)
    # the template set is a parameter: a few rows for each of its words
    table = materialize(_bands(_windows(known, ["license"], "w"), ["license"], bands).where("value is not null").distinct())
    numbered = F.filter(_zipped(F.col("w")), lambda p: p["l"].rlike("[0-9]") | p["r"].rlike("[0-9]"))
    rules = known.select("license", (F.size("w") + F.floor(F.size("w") / 5)).cast("int").alias("stretch"),
                         F.array_distinct(_hashes(_zipped(F.col("w")))).alias("pairs"), F.array_distinct(_hashes(numbered)).alias("needed"))

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", F.xxhash64("_id", "_text"))
    values = _bands(_windows(rows.select("_key", license_words(F.col("_text")).alias("w")), ["_key"], "w"), ["_key", "i"], bands)
    candidates = materialize(values.join(F.broadcast(table), "value").groupBy("_key", "license").agg(F.collect_set("i").alias("places")))
    texts = rows.select("_key", "_text").join(candidates.select("_key").distinct(), "_key", "left_semi").dropDuplicates(["_key"])
    # one hash for each neighbouring pair of words, in order
    ordered = texts.select("_key", license_words(F.col("_text")).alias("w")).select("_key", _hashes(_zipped(F.col("w"))).alias("own"))

    def holds(start: Column) -> Column:
        """Whether the stretch from ``start`` on verifies the template."""
        part = F.slice("own", start + 1, F.col("stretch") - 1)
        return (F.size(F.array_intersect(part, "pairs")) >= F.lit(containment) * F.size("pairs")) & (F.size(F.array_except("needed", part)) == 0)

    def near(place: Column) -> Column:
        """All stretches that hold the window at ``place``, if it has two of the
        template's pairs; a stretch that verifies it has such a window."""
        two = F.size(F.array_intersect(F.slice("own", place + 1, F.lit(WINDOW - 1)), "pairs")) >= F.least(F.lit(2), F.size("pairs"))
        return two & F.exists(F.sequence(F.greatest(place + F.lit(WINDOW) - F.col("stretch"), F.lit(0)), place), holds)
    checked = ordered.join(candidates, "_key").join(F.broadcast(rules), "license").where(F.exists("places", near))
    matched = checked.groupBy("_key").agg(F.sort_array(F.collect_set("license")).alias("licenses"))
    return (rows.select("_id", "_key").join(matched, "_key", "left")
            .select(F.col("_id").alias(id_col), F.coalesce(F.size("licenses"), F.lit(0)).cast("long").alias("n_licenses"),
                    F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same result in DuckDB SQL, by comparing every document with every template."""
    rows = ", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in sorted((templates or TEMPLATES).items()))
    words = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9\x{{80}}-\x{{ffff}}]+'), lambda x: x <> '')"
    pairs = "list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with t as (select license, len(w) + len(w) // 5 as stretch, list_distinct({pairs}) as p,
    list_distinct(list_filter({pairs}, lambda x: regexp_matches(x, '[0-9]'))) as needed
  from (select c0 as license, {words.format('c1')} as w from (values {rows}) v(c0, c1))),
d as (select doc_id, rn, {pairs} as own from (select doc_id, row_number() over () as rn, {words.format('text')} as w from documents)),
near as (select d.rn, d.own, t.* from d, t where len(p) > 0 and len(list_intersect(own, p)) >= {containment} * len(p)),
m as (select rn, license from near where len(list_filter(range(1, greatest(len(own) - stretch + 2, 1) + 1), lambda i:
  len(list_intersect(own[i:i + stretch - 2], p)) >= {containment} * len(p) and len(list_intersect(own[i:i + stretch - 2], needed)) = len(needed))) > 0)
select d.doc_id, count(m.license) as n_licenses, coalesce(string_agg(m.license, ',' order by m.license), '') as licenses
from d left join m using (rn) group by d.doc_id, d.rn"""
