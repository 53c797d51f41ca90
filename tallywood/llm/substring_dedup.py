"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of one document. Consecutive windows that share a minimiser (the
least hash of their ``anchor``-word runs) travel as one packed string of word codes to the minimiser's
bucket, where windows are sorted and equal neighbours counted. Equal windows have equal minimisers, so a
bucket sees every occurrence.

1. All minimisers are counted over the corpus (map-side combined). A window can recur only if its
   minimiser occurs in two super-k-mers, so the others are not sent at all; the filter is a bitmap of fixed
   size, whose false positives only cost a little traffic.
2. The remaining super-k-mers go to their buckets as strings of 48-bit codes; buckets are sorted by Spark
   (spilling) and read in chunks that end at a change of minimiser.
3. A minimiser with more than ``hot`` occurrences has no bucket: each of its windows goes by a 128-bit
   fingerprint through an ordinary aggregation with map-side combine, so no task gathers a hot group. Which minimisers
   these are is a second bitmap; one that it names falsely takes this way too, with the same result.
4. Covered word ranges go back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, binaries, bitmap, column, cut, drop, forget, id_type, in_bitmap, longs, mix, packed_binary, pieces, rolling, rows_of, scratch, shared_bytes, sliding_min, whole_groups, word_codes
from .native import bitmap_chunks, split_by_bitmap

CODE_BYTES = 6


def _super_kmers(texts: pa.Array, window: int, anchor: int):
    """(word codes, row of each super-k-mer, its first word there, in the codes, windows, minimiser)."""
    flat, counts = word_codes(texts)
    none = np.zeros(0, np.int64)
    if len(flat) < window:
        return flat, none, none, none, none, np.zeros(0, np.uint64)
    # Leftmost least run: its place rides in the low bits, so that equal windows inside one text part company too.
    run, low = mix(rolling(flat, anchor)), np.uint64((1 << 26) - 1)
    spot = sliding_min((run & ~low) | (np.arange(len(run), dtype=np.uint64) & low), window - anchor + 1) & low
    spot = np.arange(len(spot)) + ((spot.astype(np.int64) - np.arange(len(spot))) & int(low))
    first = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(flat)) - first[row] + window <= counts[row])
    if not len(at):
        return flat, none, none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(spot[at]) != 0) | (np.diff(row[at]) != 0)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    place = at[begin]
    return flat, row[place], place - first[row[place]], place, n, run[spot[place]]


def _anchors(window: int, anchor: int):
    def run(batches):
        for b in pieces(batches, "text"):
            h, c = np.unique(_super_kmers(column(b, "text"), window, anchor)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([longs(h), longs(c)], ["h", "c"])

    return run


def _send(window: int, anchor: int, bits, hot):
    def run(batches):
        for b in pieces(batches, "text"):
            flat, row, start, place, n, h = _super_kmers(column(b, "text"), window, anchor)
            mine = in_bitmap(bits.value, h)
            take = np.flatnonzero(mine & ~in_bitmap(hot.value, h) if hot else mine)
            row, start, place, n, h = row[take], start[take], place[take], n[take], h[take]
            length = n + window - 1
            total = np.cumsum(length)
            index = np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length) + np.repeat(place, length)
            data = np.ascontiguousarray(flat[index].view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]).tobytes()
            yield pa.RecordBatch.from_arrays([longs(h), rows_of(b, "doc_id", row), rows_of(b, "th", row), longs(start), packed_binary(data, total * CODE_BYTES)], ["h", "doc_id", "th", "start", "codes"])

    return run


def _fingerprints(window: int, anchor: int, bits, hot):
    def run(batches):
        for b in pieces(batches, "text"):
            flat, row, start, place, n, h = _super_kmers(column(b, "text"), window, anchor)
            take = np.flatnonzero(in_bitmap(bits.value, h) & in_bitmap(hot.value, h))
            row, start, place, n = row[take], start[take], place[take], n[take]
            total = np.cumsum(n)
            step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n)
            at = step + np.repeat(place, n)
            one, two = (rolling(flat, window, base)[at] if len(at) else np.zeros(0, np.uint64) for base in BASES)
            row = np.repeat(row, n)
            yield pa.RecordBatch.from_arrays([longs(one), longs(two), rows_of(b, "doc_id", row), rows_of(b, "th", row), longs(step + np.repeat(start, n))], ["f1", "f2", "doc_id", "th", "a"])

    return run


def _count_bucket(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Ranges of words under windows that occur twice in these whole buckets."""
    packed = batch.column(4)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    raw = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, CODE_BYTES)
    flat = np.zeros((len(raw), 8), np.uint8)
    flat[:, :CODE_BYTES] = raw
    flat = flat.view(np.uint64).reshape(-1)
    length = np.diff(offsets) // CODE_BYTES
    n = length - (window - 1)
    first = np.cumsum(length) - length
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = first[of] + step
    one, two = rolling(flat, window, BASES[0])[at], rolling(flat, window, BASES[1])[at]
    order = np.argsort(one, kind="stable")
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.flatnonzero(again)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (np.diff(of[hit]) > 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(hit)) - 1 if len(hit) else begin
    start = batch.column(3).to_numpy(zero_copy_only=False)
    row = of[hit[begin]]
    return pa.RecordBatch.from_arrays([rows_of(batch, "doc_id", row), rows_of(batch, "th", row), longs(start[row] + step[hit[begin]]), longs(start[row] + step[hit[end]] + window)], ["doc_id", "th", "a", "b"])


def _buckets(window: int, chunk_rows: int):
    def run(batches):
        for b in whole_groups(batches, chunk_rows):
            yield _count_bucket(b, window)

    return run


def _keep(batches):
    for b in pieces(batches, "text"):
        n_words, n_removed, kept = [], [], []
        ranges = b.column(b.schema.get_field_index("ranges")).to_pylist()
        for text, spans in zip(binaries(b, "text"), ranges, strict=True):
            words = (text or b"").split()
            gone = 0
            if spans:
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, [s["a"] for s in spans], 1)
                np.add.at(step, [s["b"] for s in spans], -1)
                stay = np.cumsum(step[:-1]) == 0
                gone = len(words) - int(stay.sum())
                rest = [words[i] for i in np.flatnonzero(stay).tolist()]
            else:
                rest = words
            n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(rest))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), b.column(b.schema.get_field_index("carried"))], ["doc_id", "n_words", "n_removed", "kept_text", "carried"])


def remove_repeated_windows(docs: DataFrame, window: int = 35, anchor: int = 12, hot: int = 1 << 16, chunk_rows: int = 20_000, carry: tuple = ()) -> DataFrame:
    """Words of ``docs`` (doc_id, text) without those under a window that starts anywhere else as well.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), one row per input row, and
    with ``carry`` a struct ``carried`` of those columns.

    Null or empty texts: no words, nothing removed, empty text. Texts shorter than the window keep all.
    Repeated rows and rows that share a doc_id are documents of their own. Null ids are kept as they are.
    Other columns are ignored. Ties cannot occur: every copy of a repeated window goes, none is preferred.
    ``hot``: occurrences above which a minimiser's windows go by fingerprint, so the rows of a bucket.
    """
    kind = id_type(docs)
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("int")
    whole = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("th"), carried.alias("carried"))
    base = whole.drop("carried")
    spark = docs.sparkSession
    text = base.select("text")
    seen = cut(text.mapInArrow(_anchors(window, anchor), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter("c > 1"))
    often = bitmap(seen.filter(F.col("c") > hot), "h")
    bits, hot_bits = shared_bytes(spark, bitmap(seen, "h")), shared_bytes(spark, often) if often.any() else None
    drop(seen)
    sent = base.mapInArrow(_send(window, anchor, bits, hot_bits), f"h long, doc_id {kind}, th long, start long, codes binary")
    covered = sent.repartition("h").sortWithinPartitions("h").mapInArrow(_buckets(window, chunk_rows), f"doc_id {kind}, th long, a long, b long")
    with scratch() as keep:
        if hot_bits:
            alone = keep(base.mapInArrow(_fingerprints(window, anchor, bits, hot_bits), f"f1 long, f2 long, doc_id {kind}, th long, a long"))
            twice = alone.groupBy("f1", "f2").count().filter("count > 1").select("f1", "f2")
            covered = covered.unionByName(alone.join(twice, ["f1", "f2"]).select("doc_id", "th", "a", (F.col("a") + window).alias("b")))
        ranges = cut(covered.groupBy(F.col("doc_id").alias("id"), F.col("th").alias("t")).agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    forget(bits, *([hot_bits] if hot_bits else []))
    some, rest = split_by_bitmap(whole, "th", bitmap_chunks(ranges, "t"))
    joined = some.join(ranges, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("th").eqNullSafe(F.col("t")), "left").select("doc_id", "text", "ranges", "carried")
    joined = joined.unionByName(rest.select("doc_id", "text", F.lit(None).cast(joined.schema["ranges"].dataType).alias("ranges"), "carried"))
    carried_type = joined.schema["carried"].dataType.simpleString()
    out = joined.mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, kept_text string, carried {carried_type}")
    return out if carry else out.drop("carried")


def apply_removal(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with its columns, the kept words as text."""
    out = remove_repeated_windows(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")), **settings)
    column = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[column.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns])


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB: words by the same class, windows as lists compared whole.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM s SEMI JOIN r USING (g), (SELECT unnest(range(0, 35)) AS k)),
x AS (SELECT d.doc_id, u.p, d.w[u.p] AS v FROM d, LATERAL (SELECT unnest(range(1, len(d.w) + 1)) AS p) u),
k AS (SELECT x.doc_id, string_agg(x.v, ' ' ORDER BY x.p) AS t, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
