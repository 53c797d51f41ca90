"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are near if one word edit (put in, leave out, replace) makes them equal; lines of fewer than
``least_words`` words must be equal. A line goes if an equal or near line stands earlier in the corpus, in the
order (document id, hash of its text, line number); the earliest stays.

1. Lines are hashed to 128 bits; equal lines become one distinct line with its earliest place.
2. One edit leaves either the first or the last floor(m / 2) words of the shorter line (m words) whole. Lines
   that share no such half with another line cannot have a near one and emit nothing more; this loses none.
3. The others emit all variants with one word left out, as hashed keys, in time proportional to the line:
   the hash of a word sequence is the XOR of hashes of (word, place), so a variant is a prefix and a suffix.
   Equal (variant, place left out) means a replacement; a variant equal to a whole line means a word more.
4. In a group of equal keys only the earliest line matters, found by an aggregation with map-side combine,
   so groups cost rows in proportion to their size. Each line is then verified against that earliest one on
   the words themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow, scratch
from .native import bitmap_chunks, split_by_bitmap, words

LEAST_WORDS = 8


def _lines(base: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, th, i, w (its words)."""
    return base.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "th", "i", words(F.col("line")).alias("w"))


def _halves(n, w):
    """Keys (side, length, words) of the halves that a near line must share one of."""
    p, q = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    side = lambda p: [F.xxhash64(F.lit(1), p, F.slice(w, F.lit(1), p)), F.xxhash64(F.lit(2), p, F.slice(w, n - p + 1, p))]
    return F.array_distinct(F.array(*side(p), *side(q)))


def _removals(base: DataFrame, least_words: int, keep) -> DataFrame:
    """doc_id, th, gone: line numbers to remove, for the documents that lose any."""
    place = F.struct("doc_id", "th", "i")
    n = F.size("w")
    occurrences = keep(_lines(base).select(place.alias("at"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("x"), "w").alias("h2"), F.when(n >= least_words, _halves(n, F.col("w"))).alias("halves")))
    distinct = keep(occurrences.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves")))
    keys = distinct.select("h1", "h2", "first", F.explode("halves").alias("k"))
    several = keys.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")
    asked = keys.join(several, "k", "left_semi").select("first.doc_id", "first.th", "first.i").distinct()
    by_document = keep(asked.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("i").alias("wanted")))
    texts, _ = split_by_bitmap(base, "th", bitmap_chunks(by_document, "t"))
    texts = texts.join(by_document, texts.doc_id.eqNullSafe(F.col("d")) & (texts.th == F.col("t"))).dropDuplicates(["doc_id", "th"])
    wanted = keep(texts.select("doc_id", "th", F.split("text", "\n").alias("l"), F.explode("wanted").alias("i")).select("doc_id", "th", "i", words(F.col("l")[F.col("i")]).alias("w")))
    # Variants: XOR of (word, place) hashes before the word left out, and of those after it, one place nearer.
    spelled = wanted.select("doc_id", "th", "i", F.size("w").alias("n"), F.posexplode("w").alias("j", "x")).withColumns({"a": F.xxhash64("x", "j"), "b": F.xxhash64("x", F.col("j") - 1)})
    line = Window.partitionBy("doc_id", "th", "i")
    before, upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, -1), line.orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    summed = spelled.select("doc_id", "th", "i", "n", "j", F.coalesce(F.bit_xor("a").over(before), zero).alias("pre"), F.bit_xor("b").over(upto).alias("past"), F.bit_xor("b").over(line).alias("all_b"), F.bit_xor("a").over(line).alias("whole"))
    one = F.struct((F.col("n") - 1).alias("len"), F.col("pre").bitwiseXOR(F.col("past")).bitwiseXOR(F.col("all_b")).alias("key"), "j")
    itself = F.struct(F.col("n").alias("len"), F.col("whole").alias("key"), F.lit(-1).alias("j"))
    variants = summed.select(place.alias("at"), F.explode(F.when(F.col("j") == 0, F.array(one, itself)).otherwise(F.array(one))).alias("v")).select("at", "v.len", "v.key", "v.j")
    shared = variants.groupBy("len", "key").count().filter("count > 1").select("len", "key")
    variants = keep(variants.join(shared, ["len", "key"], "left_semi"))
    # Replacements: the earliest line with the same variant and place. One word more or less: whole lines and variants of the others.
    earliest = variants.groupBy("len", "key", "j").agg(F.min("at").alias("other"))
    deleted, whole = variants.filter("j >= 0"), variants.filter("j < 0")
    first_deleted = deleted.groupBy("len", "key").agg(F.min("at").alias("other"))
    pairs = deleted.join(earliest, ["len", "key", "j"]).select("at", "other", F.col("j").alias("cut_at"), F.col("j").alias("cut_other"))
    pairs = pairs.unionByName(whole.join(first_deleted, ["len", "key"]).select("at", "other", F.lit(-1).alias("cut_at"), F.lit(None).cast("int").alias("cut_other")))
    pairs = pairs.unionByName(deleted.join(whole.select("len", "key", F.col("at").alias("other")), ["len", "key"]).select("at", "other", F.col("j").alias("cut_at"), F.lit(-1).alias("cut_other")))
    pairs = keep(pairs.filter("other < at").groupBy("at").agg(F.min(F.struct("other", "cut_at", "cut_other")).alias("p")).select("at", "p.*"))
    # Verification on the words: both lines of a pair, one word apart at most.
    named = pairs.select(F.explode(F.array("at", "other")).alias("of")).distinct()
    spoken = wanted.select(place.alias("of"), "w").join(named, "of", "left_semi")
    both = pairs.join(spoken.select(F.col("of").alias("at"), F.col("w").alias("x")), "at").join(spoken.select(F.col("of").alias("other"), F.col("w").alias("y")), "other")
    nx, ny, low = F.size("x"), F.size("y"), F.least(F.size("x"), F.size("y"))
    same_start = F.coalesce(F.array_position(F.zip_with(F.slice("x", F.lit(1), low), F.slice("y", F.lit(1), low), lambda a, b: a == b), False) - 1, F.lit(-1))
    start = F.when(same_start < 0, low).otherwise(same_start)
    rest = lambda c, n, long: F.slice(c, (start + F.when(long, 2).otherwise(1)).cast("int"), n)
    near = rest(F.col("x"), nx, nx >= ny) == rest(F.col("y"), ny, ny >= nx)
    near = both.filter(near).select(F.col("at").alias("first"), F.lit(True).alias("near"))
    judged = distinct.select("h1", "h2", "first", "copies").join(near, "first", "left").filter("copies > 1 or near").select(F.col("h1"), F.col("h2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = occurrences.select("at", "h1", "h2").join(judged, ["h1", "h2"]).filter("near or at <> first")
    return gone.groupBy(F.col("at.doc_id").alias("d"), F.col("at.th").alias("t")).agg(F.collect_set("at.i").alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines (with a word), n_removed, kept_text.

    Lines are cut at newlines; lines without a word always stay. Null texts: as empty ones, kept_text is empty.
    Rows equal in doc_id and text are one document: none of them is a copy of another. Null ids come first in
    the order. Ties in the order cannot occur otherwise. Other columns are ignored, lines of any length whole.
    """
    base = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    with scratch() as keep:
        gone = cut(_removals(base, least_words, keep))
    some, none = split_by_bitmap(base, "th", bitmap_chunks(gone, "t"))
    joined = some.join(gone, some.doc_id.eqNullSafe(F.col("d")) & (some.th == F.col("t")), "left").select("doc_id", "text", "gone")
    joined = joined.unionByName(none.select("doc_id", "text", F.lit(None).cast("array<int>").alias("gone")))
    lines = F.split("text", "\n")
    n = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    return joined.select("doc_id", n.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text"), "text")


def apply_dedup(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with its columns and the kept lines as text; documents that lose their last line with a word go.

    Rows equal in doc_id and text stay as often as they came.
    """
    found = dedup_lines(docs, **settings).filter("n_removed > 0").groupBy(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("th_")).agg(F.first("kept_text").alias("kept_"), F.first(F.col("n_lines") == F.col("n_removed")).alias("empty_"))
    text = F.coalesce("kept_", docs["text"])
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col("id_")) & (F.xxhash64(docs["text"]) == F.col("th_")), "left").filter("empty_ is null or not empty_")
    return joined.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
o AS (SELECT doc_id, i, l[i] AS line, [x FOR x IN string_split_regex(l[i], '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
u AS (SELECT w, min((doc_id, i)) AS f FROM o WHERE len(w) > 0 GROUP BY w),
v AS (SELECT f, len(w) AS n, j, array_to_string(w[1:j-1] || w[j+1:], ' ') AS k FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS j FROM u WHERE len(w) >= {LEAST_WORDS})),
z AS (SELECT f, len(w) AS n, array_to_string(w, ' ') AS k FROM u WHERE len(w) >= {LEAST_WORDS}),
r AS (SELECT v.f FROM v JOIN (SELECT n, j, k, min(f) AS m FROM v GROUP BY 1, 2, 3) USING (n, j, k) WHERE m < v.f
  UNION SELECT v.f FROM v JOIN z ON v.k = z.k AND v.n = z.n + 1 WHERE z.f < v.f UNION SELECT z.f FROM v JOIN z ON v.k = z.k AND v.n = z.n + 1 WHERE v.f < z.f),
g AS (SELECT o.doc_id, o.i FROM o JOIN u ON o.w = u.w LEFT JOIN (SELECT DISTINCT f FROM r) r ON r.f = u.f WHERE r.f IS NOT NULL OR (o.doc_id, o.i) <> u.f),
k AS (SELECT o.doc_id, count(*) FILTER (len(o.w) > 0) AS n_lines, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY o.i) AS t FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.i = g.i GROUP BY o.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k
"""
