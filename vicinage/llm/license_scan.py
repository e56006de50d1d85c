"""Licence scan: MinHash bands over overlapping windows retrieve templates, shingle containment verifies; DataFrame operations only.

Words are runs of letters and digits, ASCII capitals folded; shingles are three words. Templates are grouped by length: class
c (a power of two, at least 4) holds those of more than c/2 and at most c words; templates of fewer than three words are an error. Texts are cut into windows of 2c words every c words, so
every passage of up to c words lies whole in a window.

A window that holds the wanted 80 % of a template's shingles has a Jaccard similarity of at least 0.18 to the template (its share of
at most 2c shingles). With ``BANDS`` = 64 bands of one row it shares a band with a probability above
1 - (1 - 0.18)**64 > 0.999996. For templates of three words, a single shingle of up to six, it is 1 - (5/6)**64 > 0.99999. A band of one row can only be shared by a window that holds the template's least shingle in that band, so the bands are evaluated from that side: only windows that hold
any such shingle of a template of their class (some 64 at most for each template) get their own minima, and they are candidates if they share a band.
Exactly the pairs come out that would if all windows were hashed. Candidates are then verified on the full sets of shingles.

The templates are a list in this module or the caller's, of at most ``MAX_TEMPLATES``; only they are broadcast. A document's windows are made within its row: documents aren't shuffled
before they match, and a hot source is like any other.

Defined results: null, empty and short texts match nothing and have no row. One row for each document and template that matches: the largest
containment of a window and the first word of the first match. Rows with equal ids are merged, null ids among them. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import load, table

SHINGLE, BANDS, PERCENT, MAX_TEMPLATES = 3, 64, 80, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[^\p{L}\p{N}]+"

TEMPLATES = (
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    folded = text.translate(str.maketrans(UPPER, LOWER))
    return [w for w in re.split(r"[\W_]+", folded) if w]


def length_class(n_words: int) -> int:
    return max(4, 1 << (n_words - 1).bit_length())


def _once(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is then computed once and not for every element of an inner function."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(words: str) -> str:
    return _once(words, "u", f"if(size(u) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, size(u) - {SHINGLE}), i -> xxhash64(get(u, i), get(u, i + 1), get(u, i + 2))))")


def _minima(shingles: str) -> str:
    return _once(shingles, "u", f"transform(sequence(0, {BANDS - 1}), j -> array_min(transform(u, x -> xxhash64(x, j))))")


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``license, class, shingles`` (distinct hashes)."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES} are broadcast")
    if len({name for name, _ in templates}) < len(templates):
        raise ValueError("templates have one name each")
    rows = [(name, words, length_class(len(words))) for name, text in templates for words in [template_words(text)]]
    if short := [name for name, words, _ in rows if len(words) < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words can't be shingled: {short}")
    return spark.createDataFrame(rows, "license string, w array<string>, class int").select("license", "class", F.expr(f"array_distinct({_shingles('w')})").alias("template"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """``doc_id, license, first_word, containment``."""
    library = template_table(docs.sparkSession, templates)
    # The least shingle of each template in each band, by class: their number is bounded, as that of the templates is.
    least = library.withColumn("m", F.expr(_minima("template"))).select("class", "m", F.expr(_once("template", "u", f"transform(sequence(0, {BANDS - 1}), j -> filter(u, x -> xxhash64(x, j) = m[j])[0])")).alias("x")).collect()
    of_class: dict[int, set[int]] = {}
    for r in least:
        of_class.setdefault(r["class"], set()).update(r.x)
    words = docs.select("doc_id", F.filter(F.split(F.translate("text", UPPER, LOWER), NOT_WORD), lambda x: x != "").alias("w"))
    hashed = lambda u, i: F.xxhash64(F.get(u, i), F.get(u, i + 1), F.get(u, i + 2))
    every = sorted(set().union(*of_class.values())) or [0]
    # ``once`` binds an array: it is then computed once and not for every element of an inner function.
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    found_in = lambda u: F.filter(F.transform(F.sequence(F.lit(0), F.size(u) - SHINGLE), lambda i: F.struct(i.alias("i"), hashed(u, i).alias("x"))), lambda s: s["x"].isin(every))
    hits = words.withColumn("hit", once(F.col("w"), lambda u: F.when(F.size(u) >= SHINGLE, found_in(u)))).where("size(hit) > 0")
    # Windows k of a class start at word k c and hold the shingles up to word k c + 2 c - 3.
    own = lambda c, s: F.filter(F.array(F.floor(s["i"] / c).cast("int") - 1, F.floor(s["i"] / c).cast("int")), lambda k: (k >= 0) & (s["i"] <= k * c + 2 * c - SHINGLE))
    near = lambda c, h: F.array_distinct(F.flatten(F.transform(F.filter(h, lambda s: s["x"].isin(sorted(of_class[c]))), lambda s: own(c, s))))
    by_class = once(F.col("hit"), lambda h: F.array(*(F.struct(F.lit(c).alias("class"), near(c, h).alias("at")) for c in sorted(of_class))))
    windows = hits.select("doc_id", "w", F.explode(by_class).alias("s")).select("doc_id", "w", "s.class", F.explode("s.at").alias("k"))
    cut = windows.select("doc_id", "class", "k", F.expr("slice(w, cast(k * class as int) + 1, 2 * class)").alias("v")).select("doc_id", "class", "k", F.expr(_shingles("v")).alias("shingles"))
    window = table(cut.where("size(shingles) > 0").withColumn("window", F.monotonically_increasing_id()), "windows")
    bands = window.select("window", "class", F.posexplode(F.expr(_minima("shingles"))).alias("band", "value"))
    template_bands = library.select("license", "class", F.posexplode(F.expr(_minima("template"))).alias("band", "value"))
    candidates = bands.join(F.broadcast(template_bands), ["class", "band", "value"]).select("window", "license").distinct()
    both = candidates.join(window, "window").join(F.broadcast(library.select("license", "template")), "license")
    found = both.withColumn("common", F.size(F.array_intersect("template", "shingles"))).where(F.expr(f"100 * common >= {percent} * size(template)"))
    first = F.expr("k * class + aggregate(transform(template, x -> array_position(shingles, x)), cast(null as bigint), (a, p) -> if(p = 0, a, least(a, p))) - 1")
    return found.groupBy("doc_id", "license").agg(F.min(first).alias("first_word"), F.max(F.round(F.col("common") / F.size("template"), 6)).alias("containment"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', {}, {})".format(name, length_class(len(template_words(text))), template_words(text)) for name, text in TEMPLATES)
SQL = rf"""
with t(license, c, w) as (values {_VALUES}),
ts as (select license, c, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) as s from t),
n as (select license, count(*) as n from ts group by license),
d as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, unnest(range(0, len(w) - 2)) as p, w from d where len(w) >= 3),
h as (select doc_id, p, license, c, s from p join ts on s = w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3]),
k as (select doc_id, license, c, p, s, unnest([p // c - 1, p // c]) as k from h),
m as (select doc_id, license, k, min(p) as first_word, count(distinct s) as common from k where k >= 0 and p <= k * c + 2 * c - 3 group by all)
select doc_id, license, cast(min(first_word) as bigint) as first_word, max(round(common / n, 6)) as containment from m join n using (license) where 100 * common >= 80 * n group by doc_id, license
"""
