"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment confirms.

All in DataFrame functions. For a template of t five-word shingles, texts are cut into windows of t + s shingles that
start every s = max(1, t // 4) shingles, so every aligned copy lies whole in a window. BANDS bands of one minimum each are
compared. A window that holds CONTAINED = 0.8 of the template's shingles has a similarity of 0.8 t / (1.2 t + s) at least:
0.55 for t of 4 and more, so it shares a band with probability 1 - 0.45 ** BANDS, over 0.999997, edited or not; for t under
4 every shingle of the template counts as a minimum. A window can share a minimum with a template only if it holds
that very shingle, so only windows that hold some template's minimum are formed, and all of those: a membership test on
each shingle against a fixed set of at most BANDS entries a template. Windows that share a band are confirmed if they hold
at least CONTAINED of the template's shingles. Shingles are compared by a 64-bit hash: two different ones are taken for the
same with probability 2 ** -64 a pair.

Words are as for the other operators, lower-cased, without the punctuation in IGNORED. Null and short texts match nothing,
and a template of fewer than WORDS words is an error.
Rows with one doc_id are one document; extra columns are left out; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelflow.llm.common import let, words_of

BANDS, WORDS, CONTAINED = 16, 5, 0.8
IGNORED = ".,;:()\"'`"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Licence notices and grants, as published (fixed values).
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}


def _words(text: Column) -> Column:
    return F.filter(words_of(F.translate(F.translate(text, UPPER, LOWER), IGNORED, "")), lambda w: w != "")


def _shingles(text: Column) -> Column:
    """Hash of the shingle at every word that begins one, in order."""
    at = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
    return let(_words(text), lambda w: F.when(F.size(w) >= WORDS, at(w)).otherwise(F.array().cast("array<bigint>")))


def _minimum(window: Column, band: int) -> Column:
    """The shingle that comes first in the band's order."""
    return F.array_min(F.transform(window, lambda x: F.struct(F.xxhash64(x, F.lit(band)).alias("h"), x.alias("x"))))["x"]


def prepared(spark, templates: dict[str, str]) -> list[tuple]:
    """(name, shingles, minima by band) of each template, hashed by the same expressions as the texts; an error if one has
    fewer than WORDS words."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", _shingles(F.col("text")).alias("h"))
    rows = rows.select("name", "h", F.array(*(_minimum(F.col("h"), k) for k in range(BANDS))).alias("low")).collect()
    if short := [r["name"] for r in rows if not r["h"]]:
        raise ValueError(f"templates of fewer than {WORDS} words can't be found: {', '.join(short)}")
    return [(r["name"], list(r["h"]), list(r["low"])) for r in rows]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licence, start_word, containment and n_windows for every licence that a document holds; start_word and
    containment are those of its best window (the first of the best)."""
    spark = docs.sparkSession
    known = prepared(spark, templates or TEMPLATES)
    lens = [len(h) for _, h, _ in known]
    strides = [max(1, n // 4) for n in lens]
    anchors: dict[int, list[int]] = {}  # shingle: templates that have it for a minimum
    for t, (_, h, low) in enumerate(known):
        for x in {*low, *(h if len(h) < 4 else ())}:
            anchors.setdefault(x, []).append(t)
    rare = sorted(anchors)
    rows = docs.select(F.col(id_col), _shingles(F.col(text_col)).alias("h"))
    rows = rows.filter(F.exists("h", lambda x: x.isin(rare)))
    of = F.create_map(*(c for x in rare for c in (F.lit(x), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(lens[t]).alias("len"), F.lit(strides[t]).alias("stride")) for t in anchors[x])))))
    at = F.filter(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(rare))
    last = lambda w: F.floor((F.size("h") - 1) / w["stride"])  # noqa: E731  every shingle lies in a window, the last ones may be short
    first = lambda s, w: F.greatest(F.floor((s["i"] - w["len"]) / w["stride"]), F.lit(0))
    windows = lambda s, w: F.transform(F.sequence(first(s, w).cast("int"), F.least(F.floor(s["i"] / w["stride"]), last(w)).cast("int")), lambda j: F.struct(w["t"].alias("t"), (j * w["stride"]).alias("begin"), (w["len"] + w["stride"]).alias("size")))
    around = F.transform(at, lambda s: F.flatten(F.transform(F.element_at(of, s["x"]), lambda w: windows(s, w))))
    side = F.broadcast(spark.createDataFrame([(k, name, h, low) for k, (name, h, low) in enumerate(known)], "t int, licence string, th array<long>, low array<long>"))
    found = rows.withColumn("w", F.explode(F.array_distinct(F.flatten(around))))
    found = found.select(id_col, F.col("w.t").alias("t"), F.col("w.begin").alias("begin"), F.slice("h", F.col("w.begin") + 1, F.col("w.size")).alias("win")).join(side, "t")
    shared = F.lit(False)
    for k in range(BANDS):
        shared = shared | (_minimum(F.col("win"), k) == F.get("low", F.lit(k)))
    held = F.array_intersect("th", "win")
    found = found.filter(shared | (F.size("th") < 4)).withColumn("containment", F.size(held) / F.size(F.array_distinct("th")))
    found = found.filter(F.col("containment") >= CONTAINED)
    first = F.array_min(F.transform(held, lambda x: F.array_position("win", x))).cast("int")
    found = found.withColumn("start_word", F.col("begin") + first - 1)
    best = F.max(F.struct(F.col("containment"), (-F.col("start_word")).alias("s")))
    out = found.groupBy(id_col, "licence").agg(best.alias("b"), F.countDistinct("begin").alias("n_windows"))
    return out.select(id_col, "licence", (-F.col("b.s")).cast("int").alias("start_word"), F.round("b.containment", 6).alias("containment"), F.col("n_windows").cast("long").alias("n_windows"))
