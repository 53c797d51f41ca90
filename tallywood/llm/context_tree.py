"""LM scoring by context-tree weighting over binary-decomposed bytes, beside a word-unigram base score.

A byte is eight binary decisions. Each decision has a tree of contexts, the 0 to ``depth`` bytes before it, and in every
context a Krichevsky-Trofimov estimate. Context-tree weighting mixes the estimates of all depths with the weights
that the training counts give them; the mixed probabilities multiply to a byte's, and the bytes' to a text's.
Texts end with an end symbol (0xFF, which UTF-8 has not) and begin with padding contexts.

1. One pass counts words and (context, byte) pairs over all training texts, combined per task and summed by an
   ordinary aggregation; pairs that only held-out texts have are listed too, so scoring never meets a new one.
2. Contexts with the same two nearest bytes form a subtree (at depth 4 at most 2^24 pairs); its weights are computed in
   one task. Above, at most 65,280 sums (nearest byte, decision) meet on the driver.
3. Scoring reads the texts once more. The most frequent keys (a fixed number) travel to the tasks as hash
   tables; all other keys of a document are joined with the whole tables, so none is lost or approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, column, cut, drop, id_type, longs, narrow, pieces, rows_of, shared_bytes, whole_groups, word_codes

#: Bytes of context (2 to 7: a context and its byte are one 64-bit key), and bytes of text handled at a time.
DEPTH, PIECE_BYTES = 4, 1_000_000
#: Depth at which the tree is cut into subtrees, one for each pair of nearest bytes.
TOP = 2
PAD, END = 0xFE, 0xFF
#: Keys that travel to all tasks: (context, byte) pairs and words, 16 bytes each.
HOT_PAIRS, HOT_WORDS = 1 << 20, 1 << 18
#: Code of the end token among the words.
END_WORD = np.uint64(0x454E44)
LN10 = float(np.log(10))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series at x + 8, less the factors between."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


def pair_keys(texts: list, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """((context, byte) keys of the lower-cased texts with their ends, row of each)."""
    data = [bytes([PAD]) * depth + (t or b"").lower() + bytes([END]) for t in texts]
    x = np.frombuffer(b"".join(data), np.uint8)
    key = np.zeros(max(len(x) - depth, 0), np.uint64)
    for i in range(depth + 1):
        key = (key << np.uint64(8)) | x[i : len(x) - depth + i]
    real = x[depth:] != PAD
    row = np.repeat(np.arange(len(data)), [len(d) for d in data])[depth:]
    return key[real], row[real]


def subtree(keys: np.ndarray, n: np.ndarray, depth: int = DEPTH, top: int = TOP):
    """Context-tree weighting of one subtree, whose keys share the ``top`` nearest context bytes.

    Returns (probability of each key's 8 decisions mixed down to depth ``top``, nodes of that depth: nearest byte,
    decision, ln of the weighted probability, zeros, ones). Several subtrees may come together.
    """
    byte = (keys & np.uint64(255)).astype(np.int64)
    context = keys >> np.uint64(8)
    chance = np.ones((len(keys), 8))
    nodes = []
    for k in range(8):
        decision = (1 << k) | (byte >> (8 - k))
        bit = (byte >> (7 - k)) & 1
        weighted = first = p = None
        levels = []
        for d in range(depth, top - 1, -1):
            node = ((context & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | decision.astype(np.uint64)
            node, here, index = np.unique(node, return_index=True, return_inverse=True)
            a = np.bincount(index, n * (bit == 0), len(node))
            b = np.bincount(index, n * (bit == 1), len(node))
            own = kt_log(a, b)
            if weighted is None:
                weighted, stop = own, np.ones(len(node))
            else:  # each child counts once, by its first row
                weighted, stop = mixture(own, np.bincount(index[first], weighted, len(node)))
            first = here
            levels.append((index, a, b, stop))
        for index, a, b, stop in levels:
            estimate = (np.where(bit == 1, b[index], a[index]) + 0.5) / (a[index] + b[index] + 1)
            p = estimate if p is None else stop[index] * estimate + (1 - stop[index]) * p
        chance[:, k] = p
        nodes.append(((context[first] & np.uint64(255)).astype(np.int64), decision[first], weighted, a, b))
    return chance, tuple(np.concatenate(x) for x in zip(*nodes, strict=True))


def mixture(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, posterior weight of the node's own estimate)."""
    weighted = np.logaddexp(own, children) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


def upper_levels(sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(weight of the own estimate, chance of a one)] of depth 1, by nearest byte and decision, and of the root.

    ``sums``: rows (nearest byte, decision, sum of the children's ln weighted probabilities, zeros, ones).
    """
    at = (sums[:, 0].astype(int), sums[:, 1].astype(int))
    out, pw, a, b = [], *(np.zeros((256, 256)) for _ in range(3))
    pw[at], a[at], b[at] = sums[:, 2], sums[:, 3], sums[:, 4]
    weighted, stop = mixture(kt_log(a, b), pw)
    seen = a + b > 0
    out.append((np.where(seen, stop, 0.5), (b + 0.5) / (a + b + 1)))
    children, a, b = np.where(seen, weighted, 0).sum(0), a.sum(0), b.sum(0)
    out.append((mixture(kt_log(a, b), children)[1], (b + 0.5) / (a + b + 1)))
    return out


class HashTable:
    """Open addressing over 64-bit keys, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys) + 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.used, self.keys, self.values = np.zeros(size, bool), np.zeros(size, np.uint64), np.zeros(size)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~self.used[slot[left]]]
            at, which = np.unique(slot[free], return_index=True)
            won = free[which]
            self.used[at], self.keys[at], self.values[at] = True, keys[won], values[won]
            done = np.zeros(len(keys), bool)
            done[won] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is absent."""
        slot = self._slot(keys)
        hit = self.keys[slot] == keys
        out = np.where(hit & self.used[slot], self.values[slot], np.nan)
        left = np.flatnonzero(self.used[slot] & ~hit)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            hit = (self.keys[slot] == keys[left]) & self.used[slot]
            out[left[hit]] = self.values[slot[hit]]
            go = self.used[slot] & ~hit
            left, slot = left[go], slot[go]
        return out


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the lower-cased words, then one end per row, row of each)."""
    codes, counts = word_codes(texts, lower=True)
    rows = np.arange(len(counts))
    return np.append(codes, np.full(len(counts), END_WORD)), np.append(np.repeat(rows, counts), rows)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    keys, index = np.unique(keys, return_inverse=True)
    return keys, np.bincount(index, n, len(keys)).astype(np.int64)


def _counts(depth: int):
    """(kind, key, training count) of each task: kind 0 words, 1 (context, byte) pairs."""

    def run(batches):
        words, pairs, rows = [], [], 0

        def rows_out():
            for kind, parts in ((0, words), (1, pairs)):
                if parts:
                    keys, n = _merged(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), longs(keys), longs(n)], ["kind", "key", "n"])

        for b in pieces(batches, "text", PIECE_BYTES):
            held = np.array(b.column(b.schema.get_field_index("held_out")).to_pylist(), bool)
            texts = binaries(b, "text")
            learn = column(b, "text").filter(pa.array(~held))
            if len(learn):
                words.append(np.unique(_word_codes(learn)[0], return_counts=True))
            key, row = pair_keys(texts, depth)
            for out in (False, True):
                if len(some := key[held[row] == out]):
                    k, n = np.unique(some, return_counts=True)
                    pairs.append((k, n * 0 if out else n))
            rows += 1
            if rows % 16 == 0:
                words[:], pairs[:] = [_merged(words)] if words else [], [_merged(pairs)]
                if sum(len(p[0]) for p in (*words, *pairs)) > 2_000_000:
                    yield from rows_out()
                    words.clear()
                    pairs.clear()
        yield from rows_out()

    return run


def _grow(depth: int):
    """Subtrees of a partition sorted by the subtrees' contexts, many small ones at a time."""

    def run(batches):
        names = ["key", "n", "chance", "near", "node", "pw", "a", "b"]
        for batch in whole_groups(batches, 100_000):
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            chance, (near, node, pw, a, b) = subtree(keys, batch.column(2).to_numpy(zero_copy_only=False).astype(float), depth)
            size = len(keys)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * size + 1, 8, dtype=np.int32)), pa.array(chance.reshape(-1)))
            none, zero = pa.array(np.full(size, -1, np.int32)), pa.array(np.zeros(size))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), listed, none, none, zero, zero, zero], names)
            size = len(node)
            yield pa.RecordBatch.from_arrays([longs(np.full(size, -1)), longs(np.zeros(size)), pa.nulls(size, listed.type), pa.array(near.astype(np.int32)), pa.array(node.astype(np.int32)), pa.array(pw), pa.array(a), pa.array(b)], names)

    return run


def _mixed(levels: list[tuple[np.ndarray, np.ndarray]]):
    """Log10 probability of each key with the shares of depth 1 and of the root mixed in."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            byte, near = key & 255, (key >> 8) & 255
            chance = np.array(b.column(2).flatten()).reshape(-1, 8)
            total = np.zeros(len(byte))
            for k in range(8):
                node = (1 << k) | (byte >> (8 - k))
                bit = (byte >> (7 - k)) & 1
                p = chance[:, k]
                for (stop, one), at in zip(levels, ((near, node), node), strict=True):
                    p = stop[at] * np.where(bit == 1, one[at], 1 - one[at]) + (1 - stop[at]) * p
                total += np.log(p)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total / LN10)], ["key", "n", "value"])

    return run


def _scores(words, pairs, all_words: bool, depth: int):
    """One row per document with what the hot tables give, and one per other key of it."""

    def run(batches):
        word_table, pair_table = HashTable(*words.value), HashTable(*pairs.value)
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "kind", "key", "times"]
        for b in pieces(batches, "text", PIECE_BYTES):
            texts = binaries(b, "text")
            size = len(texts)
            code, row = _word_codes(column(b, "text"))
            c = word_table.get(code)
            cold_word = np.isnan(c)
            known = np.bincount(row, np.where(cold_word, 0, c) > 0, size)
            logs = np.bincount(row, np.log10(np.where(cold_word, 0, c) + 1), size)
            key, at = pair_keys(texts, depth)
            v = pair_table.get(key)
            cold_pair = np.isnan(v)
            score = np.bincount(at, np.where(cold_pair, 0, v), size)
            own = np.arange(size)
            kind, keys, times, of = [np.full(size, -1)], [own.astype(np.uint64) + (np.uint64(1) << np.uint64(62))], [np.zeros(size, np.int64)], [own]
            cold = [(1, key[cold_pair], at[cold_pair])] + ([] if all_words else [(0, code[cold_word], row[cold_word])])
            for k, some, rows in cold:
                if len(some):
                    order = np.lexsort((some, rows))
                    some, rows = some[order], rows[order]
                    first = np.flatnonzero(np.append(True, (np.diff(rows) != 0) | (some[1:] != some[:-1])))
                    kind.append(np.full(len(first), k))
                    keys.append(some[first])
                    times.append(np.diff(np.append(first, len(some))))
                    of.append(rows[first])
            of = np.concatenate(of)
            mine = np.arange(len(of)) < size
            whole = lambda x: np.where(mine, x[np.minimum(of, size - 1)], 0)
            yield pa.RecordBatch.from_arrays([
                rows_of(b, "uid", of), rows_of(b, "doc_id", of), rows_of(b, "held_out", of), longs(whole(np.bincount(row, minlength=size))), longs(whole(known)), pa.array(whole(logs).astype(float)), pa.array(whole(score).astype(float)), longs(whole(np.bincount(at, minlength=size))),
                pa.array(np.concatenate(kind).astype(np.int32)), longs(np.concatenate(keys)), longs(np.concatenate(times)),
            ], names)

    return run


def _packed(batches):
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(i).to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for i in (0, 1)], ["k", "v"])


def _hot(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(keys, values, are these all) of the keys that occur at least 2^m times, for the least m that gives at most ``most``."""
    octave = F.floor(F.log2(F.col("n") + 1))
    sizes = sorted(((int(o), c) for o, c in table.groupBy(octave.alias("o")).count().collect()), reverse=True)
    taken, least = 0, (sizes[0][0] + 1 if sizes else 0)
    for o, c in sizes:
        if taken + c > most:
            break
        taken, least = taken + c, o
    got = table.filter(octave >= least).select("key", "value").mapInArrow(_packed, "k binary, v binary").collect()
    return np.frombuffer(b"".join(k for k, _ in got), np.uint64), np.frombuffer(b"".join(v for _, v in got), np.float64), taken == sum(c for _, c in sizes)


def score_documents(docs: DataFrame, held_out=None, hot_words: int = HOT_WORDS, hot_pairs: int = HOT_PAIRS, depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the lower-cased text and its end), bits_per_byte (code length, end included).

    ``held_out``: a boolean column of the rows not learnt from (null: learnt from); by default crc32 of the id as
    text, mod 7 equal to 2. Null and empty texts: the end token and symbol alone. Repeated rows and shared ids:
    each row counts and is scored by itself. Without training rows N and V are 0 and every decision has chance
    1/2. ``depth``: bytes of context. Ties among hot keys only decide how a key travels, not its value. Other columns are ignored.
    """
    if not TOP <= depth <= 7:
        raise ValueError("depth must lie between 2 and 7")
    kind = id_type(docs)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2 if held_out is None else held_out
    base = narrow(docs, "doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    spark = docs.sparkSession
    counts = cut(base.select("text", "held_out").mapInArrow(_counts(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.filter("kind = 0").select("key", "n", F.col("n").cast("double").alias("value"))
    n_tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grown = cut(counts.filter("kind = 1").select(F.shiftright("key", 8).bitwiseAND((1 << 8 * TOP) - 1).alias("top"), "key", "n").repartition("top").sortWithinPartitions("top").mapInArrow(_grow(depth), "key long, n long, chance array<double>, near int, node int, pw double, a double, b double"))
    sums = np.array([tuple(r) for r in grown.filter("node >= 0").groupBy("near", "node").agg(F.sum("pw"), F.sum("a"), F.sum("b")).collect()]).reshape(-1, 5)
    pairs = cut(grown.filter("node < 0").select("key", "n", "chance").mapInArrow(_mixed(upper_levels(sums)), "key long, n long, value double"))
    drop(grown)
    word_keys, word_values, all_words = _hot(words, hot_words)
    pair_keys_, pair_values, _ = _hot(pairs, hot_pairs)
    hot_w, hot_p = shared_bytes(spark, (word_keys, word_values)), shared_bytes(spark, (pair_keys_, pair_values))
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, kind int, key long, times long"
    rows = base.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_scores(hot_w, hot_p, all_words, depth), schema)
    tables = words.select(F.lit(0).alias("kind"), "key", "value").unionByName(pairs.select(F.lit(1).alias("kind"), "key", "value"))
    valued = rows.join(tables, ["kind", "key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    word, pair = F.col("kind") == 0, F.col("kind") == 1
    summed = valued.groupBy("uid").agg(
        F.max(F.when(F.col("kind") < 0, F.col("doc_id"))).alias("doc_id"), F.first("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(word & (F.col("value") > 0), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.when(word, F.col("times") * F.log10(F.col("value") + 1)).otherwise(0.0)).alias("logs"), F.sum(F.col("score") + F.when(pair, F.col("times") * F.col("value")).otherwise(0.0)).alias("score"), F.sum("n_bytes").alias("n_bytes"),
    )
    rest = F.col("n_tokens") * F.log10(F.lit(float(n_tokens + distinct + 1)))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n_tokens)).cast("long").alias("train_tokens"), (F.col("logs") - rest).alias("base_score"), "score", (-F.col("score") * LN10 / float(np.log(2)) / F.col("n_bytes")).alias("bits_per_byte"))


def op6_context_tree_weighting(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("bits_per_byte")
