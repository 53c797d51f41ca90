"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text. The method hashes each text's normalised lines (letters only, lower case; lines without
letters as they stand), counts for each host (``source``) the distinct documents that have a line, removes lines in
more than a share of the host's distinct documents (and in more than a fixed least number of them) and rejects
documents that this depletes. Documents of equal text count once, so that copies of one document do not make its own
lines look like boilerplate; near copies are different documents.

One pass over the texts yields a narrow table (statistics and line hashes), kept in the checkpoint folder; counting
runs on that table with map-side combine, and the join back is an ordinary one that adaptive execution splits where a
line is hot. Only the texts that change or go are joined with their verdicts; a bitmap of fixed size lets the others pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrow, scratch
from .native import bitmap_chunks, let, split_by_bitmap, words

#: A line in more documents of one host than this, and than this share of them, is boilerplate; least share of words
#: that must stay.
LINE_LIMIT, LINE_SHARE, LEAST_KEPT = 100, 0.2, 0.3


def _repeat_words(grams):
    """Words under 5-word windows found twice or more: sort (hash, place), mark equal neighbours, add up."""
    n = F.size(grams)
    numbered = F.array_sort(F.arrays_zip(grams.alias("g"), F.sequence(F.lit(1), n).alias("p")))
    marked = lambda s: F.array_sort(F.array_distinct(F.flatten(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))))))
    covered = lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5))), F.lit(0).cast("long"), lambda x, y: x + y)
    return let(numbered, lambda s: let(marked(s), covered))


def normal_line(line):
    """Letters only; without any letter the line itself, so that different lines stay different."""
    return F.when(line.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))).otherwise(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _measured(docs: DataFrame) -> DataFrame:
    base = narrow(docs, "doc_id", "source", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select("doc_id", "source", F.xxhash64("text").alias("th"), F.size("w").cast("long").alias("n_words"), F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    m = F.greatest(F.size("hw") - 4, F.lit(0))
    base = base.withColumn("grams", F.transform(F.arrays_zip(*[F.slice("hw", i, m).alias(f"x{i}") for i in range(1, 6)]), lambda s: F.xxhash64(s)))
    repeated = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), _repeat_words(F.col("grams"))).otherwise(F.lit(0).cast("long"))
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words(x)).alias("n")))
    base = base.select("doc_id", "source", "th", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"), hashed.alias("lines"))
    return base.withColumn("uid", F.monotonically_increasing_id())


def verdicts(docs: DataFrame, line_limit: int = LINE_LIMIT, least_kept: float = LEAST_KEPT, line_share: float = LINE_SHARE, keep=cut) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, th (hash of the text), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, boilerplate_words, kept, boilerplate (line hashes).

    Null texts are as empty ones: no words, so base_failed. A null source is a host of its own. Repeated rows and shared
    ids: each row is judged by itself, and equal texts count as one document of their host. A line is boilerplate
    in more than ``line_limit`` documents of its host that are more than ``line_share`` of them. Lines without a
    word are no lines. Very long texts are judged whole. Other columns are ignored; ties cannot occur. ``keep`` makes
    the checkpoint that the result is read from.
    """
    rows = keep(_measured(docs))
    lines = rows.select("uid", F.coalesce("source", F.lit("\0")).alias("host"), "th", F.explode("lines").alias("l")).select("uid", "host", "th", "l.h", "l.n")
    hosts = rows.select(F.coalesce("source", F.lit("\0")).alias("host"), "th").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    often = lines.select("host", "h", "th").distinct().groupBy("host", "h").count().filter(F.col("count") > line_limit)
    common = often.join(hosts, "host").filter(F.col("count") > line_share * F.col("texts")).select("host", "h")
    lost = lines.join(common, ["host", "h"]).groupBy("uid").agg(F.sum("n").cast("long").alias("lost"), F.collect_set("h").alias("boilerplate"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("lost", F.lit(0).cast("long"))
    out = rows.drop("lines").join(lost, "uid", "left").withColumns({"base_failed": failed, "boilerplate_words": gone})
    return out.withColumn("kept", ~failed & (F.col("n_words") - gone >= least_kept * F.col("n_words"))).drop("uid", "lost", "source")


def apply_rules(docs: DataFrame, **limits) -> DataFrame:
    """Rows of ``docs`` that are kept, with their columns, texts without their host's boilerplate lines."""
    names = docs.columns
    with scratch() as keep:
        judged = verdicts(docs, keep=keep, **limits).filter("not kept or boilerplate is not null")
        marked = cut(judged.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).agg(F.max("kept").alias("kept_"), F.flatten(F.collect_set(F.coalesce("boilerplate", F.array().cast("array<bigint>")))).alias("boilerplate_")))
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    some, others = split_by_bitmap(docs.select(*[docs[c].alias(f"c{i}_") for i, c in enumerate(names)], docs["doc_id"].alias("own_id_"), docs["text"].alias("own_text_"), own.alias("own_th_")), "own_th_", bitmap_chunks(marked, "th_"))
    joined = some.join(marked, F.col("own_id_").eqNullSafe(F.col("id_")) & (F.col("own_th_") == F.col("th_")), "left").filter(F.coalesce("kept_", F.lit(True)))
    stays = F.array_join(F.filter(F.split("own_text_", "\n"), lambda x: ~F.array_contains("boilerplate_", F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.size("boilerplate_") > 0, stays).otherwise(F.col("own_text_"))
    edited = joined.select(*[(text if c == "text" else F.char_length(text).cast("long") if c == "n_chars" else F.col(f"c{i}_")).alias(c) for i, c in enumerate(names)])
    untouched = others.select(*[(F.char_length("own_text_").cast("long") if c == "n_chars" else F.col(f"c{i}_")).alias(c) for i, c in enumerate(names)])
    return edited.union(untouched)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN (SELECT doc_id, x FROM g GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, x), (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, CASE WHEN regexp_matches(x, '\p{{L}}') THEN 'L' || trim(regexp_replace(lower(x), '[^\p{{L}}]+', ' ', 'g')) ELSE '-' || array_to_string([y FOR y IN string_split_regex(x, '[\x20\x09-\x0D]+') IF y <> ''], ' ') END AS h, len([y FOR y IN string_split_regex(x, '[\x20\x09-\x0D]+') IF y <> '']) AS n FROM (SELECT doc_id, host, text, unnest(l) AS x FROM d)),
o AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
b AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT text) AS c FROM l GROUP BY host, h) JOIN o USING (host) WHERE c > {LINE_LIMIT} AND c > {LINE_SHARE} * texts),
v AS (SELECT doc_id, sum(n) AS n FROM l JOIN b USING (host, h) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(v.n, 0) AS lost FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN v ON d.doc_id = v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - lost >= {LEAST_KEPT} * n_words AS kept FROM s
"""
