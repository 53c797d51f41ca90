"""License scan by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of all texts are joined to the positions of the same k-grams in a fixed table of license
paragraphs (some 1,500 rows, so it is broadcast); a match counts if the words are the same as well. A match at word p of
the text and place t of the paragraph votes for the diagonal p - t. Votes are added up per diagonal; neighbouring
diagonals, which differ where a word was put in or left out, are merged; a merged span is verified by the share of the
paragraph's words that it covers and by its length. Where spans of different labels overlap by more than half of the
shorter one, only the one that covers the larger share stays, so licenses that differ in a word or two are told apart.
Base phrases must match on one diagonal without a gap, and are no part of this competition.

One row per document ends each document's words, so the scan needs a single pass and one shuffle of matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow
from .native import words

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and labels.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Words of a k-gram, for phrases and for paragraphs; diagonals this near are merged; least share of words covered.
K_BASE, K, NEAR, COVER = 2, 4, 3, 0.6
#: Most words of a paragraph: its places and the words they cover are bits of one long.
MOST_WORDS = 63
_CC = "this work is licensed under a creative commons {} 4 0 international license"
_CC_URL = "creativecommons org licenses {} 4 0"
_GNU = [
    "this {1} is free software you can redistribute it and or modify it under the terms of the gnu {0}general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this {1} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0}general public license for more details",
    "you should have received a copy of the gnu {0}general public license along with this {1} if not see",
]
#: Paragraphs of the notices of well-known public licenses.
TEMPLATES = {
    "agpl": [x.format("affero ", "program") for x in _GNU],
    "apache-2.0": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort",
    ],
    "cc-by": [_CC.format("attribution"), _CC_URL.format("by")],
    "cc-by-nc": [_CC.format("attribution noncommercial"), _CC_URL.format("by nc")],
    "cc-by-nc-nd": [_CC.format("attribution noncommercial noderivatives"), _CC_URL.format("by nc nd")],
    "cc-by-nc-sa": [_CC.format("attribution noncommercial sharealike"), _CC_URL.format("by nc sa")],
    "cc-by-nd": [_CC.format("attribution noderivatives"), _CC_URL.format("by nd")],
    "cc-by-sa": [_CC.format("attribution sharealike"), _CC_URL.format("by sa")],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law",
    ],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"],
    "gpl": [x.format("", "program") for x in _GNU],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ],
    "lgpl": [x.format("lesser ", "library") for x in _GNU],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    ],
}


def _positions() -> list[tuple]:
    """(paragraph number, base?, label, k-gram, place, k-grams of the paragraph)."""
    out = []
    for number, (base, label, text) in enumerate([*((True, *x) for x in PHRASES.items()), *((False, label, x) for label, texts in TEMPLATES.items() for x in texts)]):
        w, k = text.split(), K_BASE if base else K
        if len(w) > MOST_WORDS:
            raise ValueError(f"a paragraph of {label} has more than {MOST_WORDS} words")
        out += [(number, base, label, w[i : i + k], i, len(w) - k + 1) for i in range(len(w) - k + 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans (label, first word, words, share of the paragraph covered).

    Null and empty texts: no words, no labels, null first and last word, score 0. Repeated rows and shared
    ids: each row is scanned by itself. ``score``: the largest share covered, 1 with a base phrase. Other
    columns are ignored. Of overlapping spans that cover equal shares the one that covers more words stays, then the
    one whose paragraph comes first; labels are distinct and sorted. Texts of any length are whole.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(_positions(), "tpl int, base boolean, label string, gram array<string>, at int, grams int").withColumn("bit", F.expr("shiftleft(1L, at)"))
    side = lambda base, x: F.broadcast(table.filter(F.col("base") == base).select(F.xxhash64(*[F.col("gram")[i] for i in range(K_BASE if base else K)]).alias(f"h{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("tpl", "at", "bit", "gram")]))
    split = narrow(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.concat(words(F.translate("text", UPPER, LOWER), SEPARATOR), F.array(F.lit(""))).alias("w"))
    # The last element, an empty word, stands for the document itself.
    shifted = [F.col("w"), *[F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))) for i in range(1, K)]]
    grams = split.select("uid", "doc_id", F.posexplode(F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)]))).select(
        "uid", "doc_id", "pos", "col", (F.col("col.w0") == "").alias("own"), F.xxhash64("col.w0", "col.w1").alias("hb"), F.xxhash64(*[F.col(f"col.w{i}") for i in range(K)]).alias("ht")
    )
    matched = grams.join(side(True, "b"), "hb", "left").join(side(False, "t"), "ht", "left").filter("own or tplb is not null or tplt is not null")
    same = lambda x, k: F.array(*[F.col(f"col.w{i}") for i in range(k)]) == F.col(f"gram{x}")
    vote = lambda x: F.struct(F.col(f"tpl{x}").alias("tpl"), (F.col("pos") - F.col(f"at{x}")).alias("diagonal"), F.col(f"bit{x}").alias("bit"))
    own = F.struct(F.lit(-1).alias("tpl"), F.lit(0).alias("diagonal"), F.lit(0).cast("long").alias("bit"))
    votes = matched.select("uid", "doc_id", "pos", F.explode(F.filter(F.array(F.when(F.col("own"), own), F.when(same("b", K_BASE), vote("b")), F.when(same("t", K), vote("t"))), lambda x: x.isNotNull())).alias("v"))
    diagonals = votes.repartition("uid").groupBy("uid", "v.tpl", "v.diagonal").agg(F.first("doc_id").alias("doc_id"), F.bit_or("v.bit").alias("bits"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    facts = F.broadcast(table.groupBy("tpl").agg(F.first("base").alias("base"), F.first("label").alias("label"), F.first("grams").alias("grams")))
    diagonals = diagonals.join(facts, "tpl", "left")
    # Base phrases stay on their diagonal: each one is a cluster of its own.
    along = Window.partitionBy("uid", "tpl").orderBy("diagonal")
    new = F.coalesce(F.col("base"), F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR)
    merged = diagonals.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(along))
    spans = merged.groupBy("uid", "tpl", "cluster").agg(*[F.first(c).alias(c) for c in ("doc_id", "base", "label", "grams")], F.bit_or("bits").alias("bits"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("diagonal").alias("start"))
    k = F.when(F.col("base"), K_BASE).otherwise(K)
    under = F.col("bits")
    for i in range(1, K):
        under = under.bitwiseOR(F.shiftleft("bits", i))
    covered = F.when(F.col("base"), F.bit_count("bits")).otherwise(F.bit_count(under))
    share = F.col("covered") / (F.col("grams") + F.when(F.col("base"), 0).otherwise(K - 1))
    spans = spans.withColumns({"covered": covered, "len": F.col("p1") - F.col("p0") + k}).withColumn("share", share)
    found = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise((F.col("share") >= COVER) & (F.col("len") <= 1.5 * (F.col("grams") + K - 1) + NEAR)) & (F.col("tpl") >= 0)
    spans = spans.withColumn("found", F.coalesce(found, F.lit(False)))
    # A span of at most 1.5 times the longest paragraph can only overlap spans that begin as near.
    far = int(1.5 * MOST_WORDS) + NEAR
    fields = ("share", "covered", "tpl", "label", "p0", "len")
    around = F.collect_list(F.when(F.col("found") & ~F.col("base"), F.struct(*fields))).over(Window.partitionBy("uid").orderBy("p0").rangeBetween(-far, far))
    better = lambda x: (x["share"] > F.col("share")) | ((x["share"] == F.col("share")) & ((x["covered"] > F.col("covered")) | ((x["covered"] == F.col("covered")) & (x["tpl"] < F.col("tpl")))))
    overlap = lambda x: F.least(x["p0"] + x["len"], F.col("p0") + F.col("len")) - F.greatest(x["p0"], F.col("p0")) > 0.5 * F.least(x["len"], F.col("len"))
    beaten = F.exists("around", lambda x: (x["label"] != F.col("label")) & better(x) & overlap(x))
    spans = spans.withColumn("around", around).withColumn("found", F.col("found") & (F.col("base") | ~beaten))
    at_base = F.when(F.col("found") & F.col("base"), F.col("start"))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return spans.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("tpl") == -1, F.col("p1"))).cast("long").alias("n_words"), F.count(at_base).alias("n_base"), F.min(at_base).cast("long").alias("first_word"), F.max(at_base).cast("long").alias("last_word"),
        listed(F.collect_set(F.when(F.col("found") & F.col("base"), F.col("label")))).alias("base_labels"), listed(F.collect_set(F.when(F.col("found"), F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("base"), F.when(F.col("found"), 1.0)).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("found"), F.struct(F.col("p0").alias("first"), F.col("len").alias("words"), "label", "share")))).alias("spans"),
    ).drop("uid")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _sql() -> str:
    rows = ", ".join(f"({n}, {str(base).lower()}, '{label}', '{' '.join(gram)}', {at}, {grams})" for n, base, label, gram, at, grams in _positions())
    return rf"""
WITH t(tpl, base, label, gram, place, grams) AS (VALUES {rows}),
d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}') IF x <> ''] AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+1], ' ') AS gb, CASE WHEN i + {K - 1} <= len(w) THEN array_to_string(w[i:i+{K - 1}], ' ') END AS gt FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
m AS (SELECT doc_id, pos, tpl, base, label, grams, place, pos - place AS dg FROM g JOIN t ON base AND gram = gb UNION ALL SELECT doc_id, pos, tpl, base, label, grams, place, pos - place FROM g JOIN t ON NOT base AND gram = gt),
n AS (SELECT *, CASE WHEN base OR dg - lag(dg) OVER (PARTITION BY doc_id, tpl ORDER BY dg) > {NEAR} THEN 1 WHEN lag(dg) OVER (PARTITION BY doc_id, tpl ORDER BY dg) IS NULL THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT doc_id, tpl, base, dg FROM m)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tpl ORDER BY dg) AS cl FROM n),
s AS (SELECT m.doc_id, m.tpl, any_value(m.base) AS base, any_value(label) AS label, any_value(grams) AS grams, list_distinct(list(place)) AS places, min(pos) AS p0, max(pos) AS p1, min(m.dg) AS start FROM m JOIN c ON m.doc_id = c.doc_id AND m.tpl = c.tpl AND m.dg = c.dg GROUP BY m.doc_id, m.tpl, cl),
e AS (SELECT *, CASE WHEN base THEN len(places) ELSE len(list_distinct(flatten([[x, x + 1, x + 2, x + 3] FOR x IN places]))) END AS covered, CASE WHEN base THEN grams ELSE grams + {K - 1} END AS whole, p1 - p0 + CASE WHEN base THEN {K_BASE} ELSE {K} END AS size FROM s),
f AS (SELECT *, covered / whole AS share, CASE WHEN base THEN covered = grams ELSE covered / whole >= {COVER} AND size <= 1.5 * whole + {NEAR} END AS likely FROM e),
b AS (SELECT DISTINCT x.doc_id, x.tpl, x.start, x.p0 FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.label <> y.label WHERE x.likely AND y.likely AND NOT x.base AND NOT y.base
  AND (y.share > x.share OR (y.share = x.share AND (y.covered > x.covered OR (y.covered = x.covered AND y.tpl < x.tpl)))) AND least(x.p0 + x.size, y.p0 + y.size) - greatest(x.p0, y.p0) > 0.5 * least(x.size, y.size)),
h AS (SELECT f.*, likely AND b.doc_id IS NULL AS found FROM f LEFT JOIN b ON f.doc_id = b.doc_id AND f.tpl = b.tpl AND f.start = b.start AND f.p0 = b.p0 AND NOT f.base)
SELECT d.doc_id, any_value(len(w))::BIGINT AS n_words, count(*) FILTER (found AND base) AS n_base, min(start) FILTER (found AND base)::BIGINT AS first_word, max(start) FILTER (found AND base)::BIGINT AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found), '') AS labels,
coalesce(max(CASE WHEN NOT base THEN share WHEN found THEN 1.0 END), 0.0)::DOUBLE AS score
FROM d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id
"""


OP2_SQL = _sql()
