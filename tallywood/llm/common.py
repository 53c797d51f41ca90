"""Helpers shared by the corpus operators: word codes, rolling hashes, fixed-size bitmaps, components.

Worker-side helpers handle whole texts as bytes: ``bytes.lower`` changes A-Z only and ``bytes.split``
splits at exactly ``[\\x20\\x09-\\x0D]+``, which are the definitions the operators use.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import tempfile
import types
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the rolling hashes (any odd 64-bit numbers do).
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bits of a bitmap that is sent to the driver and back: 16 MB whatever the input.
BITMAP_BITS = 1 << 27


#: Spark's settings that let files go: shuffle files at an execution's end, checkpoints that no plan refers to any more.
SHUFFLE_CLEANUP, CHECKPOINT_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.cleaner.referenceTracking.cleanCheckpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only in local mode, and only where none is named, a temporary one is made, which
    goes with the session; a cluster without one is an error, since its machines share no other folder."""
    context = spark.sparkContext._jsc.sc()
    context.conf().set(CHECKPOINT_CLEANUP, "true")
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def passing(df: DataFrame) -> DataFrame:
    """``df`` for a single action, at whose end its shuffle files go."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors lose nothing. Its shuffle
    files go at once, its checkpoint when nothing refers to it any more."""
    checkpoint_dir(df.sparkSession)
    return passing(df).checkpoint(True)


def drop(df: DataFrame) -> None:
    """Deletes the checkpoint that ``cut`` made; only for frames that nothing will read again."""
    place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if place.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """``cut`` for frames that are read within the block only: their checkpoints go at its end."""
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(cut(df))
        return made[-1]

    yield keep
    for df in made:
        drop(df)


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, each once, so that extra or clashing columns cannot interfere."""
    return docs.select(*[docs[c] for c in columns])


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()


class Remembered(dict):
    """A table of two generations: at ``limit`` entries the present one becomes the older one, whose entries
    still in use come back. Memory stays bounded and frequent keys stay known."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.older = limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def make(self, key):
        raise NotImplementedError


def kept_by_worker(key, make):
    """What ``make`` returns, kept in this worker process for later tasks; a worker keeps one such thing."""
    held = sys.modules.setdefault("tallywood_worker_state", types.ModuleType("tallywood_worker_state"))
    if getattr(held, "key", None) != key:
        held.key, held.value = None, None
        held.value = make()
        held.key = key
    return held.value


def trim() -> None:
    """Gives memory that this worker process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def forget_kept() -> None:
    """Drops what an earlier operator kept in this worker process."""
    held = sys.modules.get("tallywood_worker_state")
    if held is not None and getattr(held, "key", None) is not None:
        held.key, held.value = None, None
        gc.collect()
        trim()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word of the column among them, words of each row), by Arrow's kernels.

    Words are those of ``bytes.split``; ``lower`` changes A-Z only.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten().dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = pc.index(flat.dictionary, "").as_py()  # around white space at an end, or for an empty text
    if empty >= 0:
        real = index != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[real], minlength=len(counts))
        index = index[real]
    return flat.dictionary, index, counts


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit code of each word of the column, words of each row)."""
    distinct, index, counts = split_words(texts, lower)
    data = distinct.cast(pa.binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))[index], counts


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def rolling(codes: np.ndarray, m: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each run of m codes, by doubling: O(len * log m) vector operations."""
    n = len(codes)
    if n < m:
        return np.zeros(0, np.uint64)
    out, length, block, width = None, 0, codes, 1
    while True:
        if m & width:
            out = block if out is None else out[: n - length - width + 1] * power(base, width) + block[length:]
            length += width
        if 2 * width > m:
            return out[: n - m + 1]
        block = block[:-width] * power(base, width) + block[width:]
        width *= 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    n, width = len(x), 1
    while 2 * width <= k:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == k else np.minimum(x[: n - k + 1], x[k - width :])


def binaries(batch: pa.RecordBatch, column: str) -> list:
    """The column as bytes (null texts as None) without decoding."""
    c = batch.column(batch.schema.get_field_index(column))
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows_of(arrow_type_source: pa.RecordBatch, column: str, take: np.ndarray) -> pa.Array:
    return arrow_type_source.column(arrow_type_source.schema.get_field_index(column)).take(pa.array(take))


def packed_binary(data: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column whose values stand one after another in ``data``; ``ends``: where each one ends."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most_bytes`` (a single row may hold more)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """A sorted partition in chunks of about ``rows`` rows, each ending where column 0 changes."""
    held, count = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy(zero_copy_only=False)
        if count >= rows and held[-1].column(0)[-1].as_py() != h[0]:
            yield joined()
            held, count = [], 0
        change = np.flatnonzero(np.diff(h)) + 1
        last = int(change[-1]) if len(change) else 0
        if last and count + last >= rows:
            held.append(b.slice(0, last))
            yield joined()
            held, count, b = [], 0, b.slice(last)
        held.append(b)
        count += b.num_rows
    if held:
        yield joined()


def bitmaps(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Fixed-size bitmap (16 MB) of the hashes in each of the columns: tells which values may be in it; others aren't.

    It is a pre-filter only: the larger the input, the fewer rows it spares, and never is one lost.
    """
    each = df.select(F.posexplode(F.array(*[F.col(c) for c in columns])).alias("i", "h"))
    bit = F.col("h").bitwiseAND(BITMAP_BITS - 1)
    got = passing(each.groupBy("i", F.shiftright(bit, 15).alias("k")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("b"))).collect()
    out = [np.zeros((BITMAP_BITS >> 15, 4096), np.uint8) for _ in columns]
    for i, k, b in got:
        out[i][k] = np.frombuffer(b, np.uint8)
    return [x.reshape(-1) for x in out]


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    return bitmaps(df, column)[0]


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(BITMAP_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _contracted(named: bool):
    """A partition's links as a forest of stars around the least nodes; ``named``: with those nodes themselves."""

    def run(batches):
        parts = [np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches if b.num_rows]
        if not parts:
            return
        nodes, index = np.unique(np.concatenate(parts, 1), return_inverse=True)
        a, b = index.reshape(2, -1)
        parent = np.arange(len(nodes))
        while len(at := np.flatnonzero(parent[a] != parent[b])):
            x, y = parent[a[at]], parent[b[at]]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent[parent] != parent).any():
                parent = parent[parent]
        keep = slice(None) if named else np.flatnonzero(parent != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[parent][keep])], ["u", "v"])

    return run


def components(edges: DataFrame, keep=cut, most: int = 1 << 18) -> DataFrame:
    """Connected components of links (u, v), both long: rows (node, component), component the least node.

    Links are contracted within partitions of about ``most`` links; if one holds all of them, that is the answer. Else
    large-star and small-star steps alternate until nothing changes; every step is a distributed aggregation and join
    whose result is checkpointed, so the number of rounds grows with the logarithm of a component's size. The result
    is a checkpoint made by ``keep``.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    n = e.count()
    if n <= most:
        found = keep(e.coalesce(1).mapInArrow(_contracted(True), "node long, component long"))
        drop(e)
        return found
    forest = cut(e.coalesce(-(-n // most)).mapInArrow(_contracted(False), "u long, v long"))
    drop(e)
    e, before = forest, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        after = cut(star.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct())
        drop(e)
        e = after
        now = passing(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND((1 << 40) - 1)))).first()
        if now == before:
            break
        before = now
    found = keep(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
    drop(e)
    return found


def shared_bytes(spark: SparkSession, value):
    """A value of bounded size for the workers."""
    return spark.sparkContext.broadcast(value)


def forget(*shared) -> None:
    """Takes ``shared_bytes`` away from the workers and the driver's disk; only for values that nothing will read again.

    ``unpersist`` would leave the driver's file, as large as the value, until the session ends.
    """
    for b in shared:
        b.destroy()


def tokenizer_path(name: str, path: str | None = None) -> str:
    """``path``, else the place of a vocabulary file of the installed public tokenizers."""
    if path:
        return path
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
