"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector, which a fixed random projection takes to few
dimensions; the cell's Hilbert key orders documents so that neighbours in content are neighbours in
sequence. Documents are range-partitioned and sorted by (key, id), and each partition is one stream cut
into sequences of ``length`` tokens. What is left at a stream's end becomes sequences whose lengths are
powers of two, so nothing is padded anywhere.

Equal keys (copies) are spread by the id in the range key, so a hot key is not one task. The only shuffle
carries 16-bit token ids where the vocabulary allows.
"""

from __future__ import annotations

import bisect
import gc
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_type, kept_by_worker, mix, narrow, packed_binary, pieces, split_words, tokenizer_path, trim

DIMENSIONS, BITS, FEATURES = 4, 10, 256
#: Documents (about) whose keys set the ranges' borders.
BORDER_SAMPLE = 5_000


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer cells (rows of coordinates), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: A run of letters, or of ASCII punctuation but for the apostrophe and the signs of special tokens.
PLAIN = re.compile(r"(?:[^\W\d_]+|[!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]+)+")
UNIT = re.compile(r"[!\"#$%&()*+,\-./:;=?@\[\]^_`{}~]+")
PARTS = re.compile(r"[^\W\d_]+|[^\w]+|_+")


class TokenCodes(dict):
    """White-space word -> its ids as bytes; this tokenizer treats words apart, and letters and punctuation in them."""

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.last = np.zeros(1 << 16 if self.kind == "<u2" else 1 << 24, bool)
        self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True

    def parts(self, word: str) -> tuple[str, ...] | list[str]:
        """Pieces of a word that the tokenizer treats apart."""
        if word.isalpha() or "_" in word or not PLAIN.fullmatch(word) or not (word.isascii() or PLAIN.fullmatch(word.lower())):
            return (word,)
        return PARTS.findall(word)

    def encode_new(self, words: list[str]) -> list[bytes]:
        """Ids of words. Runs of letters or of punctuation are single units, whose last ids are marked in the
        vocabulary, so thousands of them are one text for the tokenizer; all other words go one by one."""
        out: dict[str, bytes] = {}
        units = [w for w in words if w.isalpha() or UNIT.fullmatch(w)]
        for i in range(0, len(units), 20_000):
            part = units[i : i + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
            if len(ends) == len(part):
                data, begin = ids.tobytes(), 0
                for w, end in zip(part, ends.tolist(), strict=True):
                    out[w] = data[begin:end]
                    begin = end
        rest = [w for w in words if w not in out]
        for i in range(0, len(rest), 5000):
            for w, e in zip(part := rest[i : i + 5000], self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, self.kind).tobytes()
        return [out[w] for w in words]

    def codes(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, as bytes."""
        found = list(map(self.get, words))
        new = [i for i, c in enumerate(found) if c is None]
        split = {i: p for i in new if len(p := self.parts(words[i])) > 1}
        apart = [words[i] for i in new if i not in split]
        apart += dict.fromkeys(p for parts in split.values() for p in parts if p not in self)
        apart = list(dict.fromkeys(apart))
        coded = dict(zip(apart, self.encode_new(apart), strict=True))
        for i in new:
            found[i] = b"".join([coded.get(p) or self.get(p) or b"" for p in split[i]]) if i in split else coded[words[i]]
        if len(self) + len(coded) > self.limit:
            self.clear()
        self.update(coded)
        return found


def hilbert_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's hashed token vector; ``ids`` of all documents, ``ends``: where each one ends."""
    rng = np.random.default_rng(20_240_229)
    project = rng.standard_normal((FEATURES, DIMENSIONS))
    slot = (mix(np.arange(1 << 16, dtype=np.uint64)) >> np.uint64(56)).astype(np.int64)
    hashed = slot[ids & 0xFFFF]
    vectors = np.stack([np.bincount(hashed[a:b], minlength=FEATURES) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]).astype(float)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = (vectors / np.where(norm > 0, norm, 1)) @ project
    cells = np.clip(((np.tanh(flat) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_key(cells, BITS)


def _place(key: int, doc_id) -> tuple:
    """Order along the curve: key, then id, nulls first."""
    return (key, doc_id is not None, doc_id if doc_id is not None else 0)


def _tokens(path: str, end_id: int, borders: list[tuple]):
    def run(batches):
        codes = kept_by_worker(path, lambda: TokenCodes(path))
        for b in pieces(batches, "text", 16_000_000):
            distinct, index, counts = split_words(column(b, "text"), lower=True)
            gc.disable()  # many small objects, none in cycles
            coded = [*codes.codes(distinct.to_pylist()), np.array([end_id], codes.kind).tobytes()]
            gc.enable()
            # Ids of every word in order, the end id after each document's.
            order = np.full(len(index) + len(counts), len(coded) - 1, np.int64)
            stops = np.cumsum(counts + 1)
            place = np.ones(len(order), bool)
            place[stops - 1] = False
            order[place] = index
            size = np.array([len(c) for c in coded], np.int64) // np.dtype(codes.kind).itemsize
            begin = np.cumsum(size) - size
            each = size[order]
            total = np.cumsum(each)
            flat = np.frombuffer(b"".join(coded), codes.kind)[np.repeat(begin[order] - (total - each), each) + np.arange(total[-1] if len(total) else 0)]
            ends = total[stops - 1]
            keys = hilbert_of(flat, ends)
            data = packed_binary(flat.tobytes(), ends * flat.itemsize)
            ids = b.column(b.schema.get_field_index("doc_id"))
            part = [bisect.bisect_right(borders, _place(k, i)) for k, i in zip(keys.tolist(), ids.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(part, pa.int32()), data], ["doc_id", "key", "part", "ids"])
        trim()

    return run


def cuts(total: int, length: int) -> list[int]:
    """Sequence lengths of a stream: full ones, then powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(length: int, kind: str):
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        room = length
        waiting: list = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        held = 0

        def emit(parts: list) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate([id_kind, *[pa.int64()] * 5, pa.binary()])], names)

        id_kind, out = pa.int64(), []
        for b in batches:
            id_kind = b.column(0).type
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, kind)
                start = 0
                while start < len(ids):
                    take = min(len(ids) - start, room - held)
                    waiting.append((doc_id, start, take, len(ids), sequence, held, ids[start : start + take].astype("<u4").tobytes()))
                    held += take
                    start += take
                    if held == room:
                        out += waiting
                        waiting, held, sequence = [], 0, sequence + 1
                if len(out) >= 2000:
                    yield emit(out)
                    out = []
        # The open sequence is cut into powers of two.
        for room in cuts(held, length):
            offset = 0
            while offset < room:
                doc_id, start, n, tokens, _, _, data = waiting.pop(0)
                take = min(n, room - offset)
                out.append((doc_id, start, take, tokens, sequence, offset, data[: 4 * take]))
                if take < n:
                    waiting.insert(0, (doc_id, start + take, n - take, tokens, 0, 0, data[4 * take :]))
                offset += take
            sequence += 1
        if out:
            yield emit(out)

    return run


def pack(docs: DataFrame, length: int = 4096, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary).

    ``ids`` are little-endian unsigned 32-bit token ids; sequence lengths are ``length`` or powers of two, so
    there is no padding. Null and empty texts: the end id alone. Repeated rows and shared ids: each row is
    packed. Equal Hilbert keys (ties) are ordered by doc_id, nulls first; rows equal in both stand in any order.
    Very long texts are cut over as many sequences as they fill. Other columns are ignored.
    """
    path = tokenizer_path("word_bpe_49k.json", tokenizer)
    kind = id_type(docs)
    base = narrow(docs, "doc_id", "text")
    spark = docs.sparkSession
    schema = f"doc_id {kind}, key long, part int, ids binary"
    # Borders of the ranges, from a bounded sample; they only balance the tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = base.count()
    sample = base.sample(False, BORDER_SAMPLE / rows, 11) if rows > BORDER_SAMPLE else base
    drawn = sorted((_place(k, i), n) for i, k, n in sample.mapInArrow(_tokens(path, end_id, []), schema).select("doc_id", "key", F.octet_length("ids")).collect())
    weight = np.cumsum([n for _, n in drawn]) if drawn else np.zeros(0)
    borders = [drawn[i][0] for i in sorted({int(np.searchsorted(weight, weight[-1] * k / parts)) for k in range(1, parts)})] if drawn else []
    tokens = base.mapInArrow(_tokens(path, end_id, borders), schema)
    ranged = tokens.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "ids")
    from tokenizers import Tokenizer

    narrow_ids = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16
    return ranged.mapInArrow(_pack(length, "<u2" if narrow_ids else "<u4"), f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_curve_packing(spark, sf_dir: str) -> DataFrame:
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
