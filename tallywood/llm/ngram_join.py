"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct 5-word shingles (64-bit hashes). Two sets link at Jaccard >= 0.8.

1. One pass hashes every set: a 128-bit signature and a bitmap of parities per document, and a count of all
   shingles in a fixed-size sketch. Equal sets become one class. Two sets differ in at least as many items as
   their parities differ in bits, which is the suffix filter; it lets through little below the similarity.
2. Shingles are ordered by (sketch count, hash), rare first; any total order keeps prefix filtering exact.
   The first n - ceil(0.8 n) + 1 shingles of each set go to their shingle's group, where groups with one
   class end.
3. Star round: a few shingles of each prefix only. A group's centre is the class nearest to the majority of
   the group's parities, usually the text that the others were made from; classes that pass the filters meet
   it, so a group of near copies costs pairs in proportion to its size. Links join classes into components.
4. Groups whose classes of compatible lengths are in one component end. The others are compared inside the
   tasks, row by row against blocks: first a spanning forest of what passes the filters, then, after its
   links have joined components, every pair that passes and is not yet in one component, so no link that
   would change a component is lost.

Every pair is verified once on the whole sets. Joins are ordinary shuffles, which adaptive execution splits
where a key is hot; the driver sees the sketch and bitmaps only, both of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmaps, column, components, cut, drop, forget, forget_kept, id_type, in_bitmap, longs, mix, narrow, packed_binary, passing, pieces, rolling, scratch, shared_bytes, whole_groups, word_codes
from .native import bitmap_chunks, split_by_bitmap

SHINGLE = 5
#: Counters of the frequency sketch (a power of two).
SKETCH = 1 << 18
#: Bytes of text that a task hashes at a time.
PIECE_BYTES = 3_000_000
#: Rows of groups that are looked at together.
GROUP_ROWS = 20_000
#: Shingles of a prefix that are used in the star round (it only saves work: the later rounds take all).
STAR_SHINGLES = 6
#: Centres of a group in the star round.
STAR_CENTRES = 6
#: Largest parities of a row of a group, and of a class for the filter of pairs, as powers of two.
ROW_BITS, PAIR_BITS = 11, 16
#: Sets above this size have larger parities for the filter of pairs.
LONG = 1 << (ROW_BITS - 1)
#: Groups up to this size are compared together, larger ones one at a time.
SMALL_GROUP = 32


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's 5-word shingles."""
    codes, counts = word_codes(texts, lower=True)
    grams = mix(rolling(codes, SHINGLE))
    out = []
    for row, (end, n) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)):
        if n >= SHINGLE:
            out.append(np.unique(grams[end - n : end - SHINGLE + 1]))
        elif n:
            whole = b" ".join(texts[row].as_py().encode().lower().split())
            out.append(np.array([xxhash.xxh3_64_intdigest(whole, seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(s: np.ndarray, twins: frozenset = frozenset()) -> int:
    """64-bit class key of a set as a signed number; a second hash where different sets share the first (``twins``)."""
    key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
    return _second(s) if key in twins else key


def _second(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=7) - (1 << 63)


def _parity(s: np.ndarray, largest: int) -> bytes:
    """Parities of the set's counts over 128 to 2 ** ``largest`` bins, a power of two of at least 1.5 bins per item if that is in range.

    With less than half a bin per item parities say nothing, and the smallest bitmap stands for them.
    """
    bits = 1 << min(largest, max(7, (3 * len(s) // 2).bit_length()))
    if 2 * bits < len(s):
        return bytes(16)
    at = ((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


class _Parities:
    """A column of parity bitmaps; those of twice the size are folded where they meet smaller ones."""

    def __init__(self, column: pa.Array):
        data = column.to_pylist()
        self.size = np.fromiter(map(len, data), np.int64, len(data))
        self.tables = {}
        for size in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == size)
            own = np.frombuffer(b"".join([data[i] for i in at.tolist()]), np.uint64).reshape(len(at), -1)
            above = np.flatnonzero(self.size == 2 * size)
            if len(above):
                twice = np.frombuffer(b"".join([data[i] for i in above.tolist()]), np.uint64).reshape(len(above), 2, -1)
                own = np.concatenate((own, twice[:, 0] ^ twice[:, 1]))
            place = np.full(len(data), -1, np.int64)
            place[np.concatenate((at, above))] = np.arange(len(own))
            self.tables[size] = place, own

    def distance(self, i: np.ndarray, j: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Least number of items in which the sets of rows i and j differ; 0 where the sizes are too far apart."""
        i, j = np.broadcast_arrays(i, j)
        out = np.zeros(len(i), np.int64)
        size = np.minimum(self.size[i], self.size[j])
        for s in np.unique(size).tolist():
            place, rows = self.tables[s]
            sel = np.flatnonzero((size == s) & (place[i] >= 0) & (place[j] >= 0))
            for k in range(0, len(sel), block):
                at = sel[k : k + block]
                out[at] = np.bitwise_count(rows[place[i[at]]] ^ rows[place[j[at]]]).sum(1)
        return out

    def nearest_to_majority(self, among: np.ndarray, like: int, block: int = 1 << 12) -> int:
        """The row of ``among`` nearest to the majority of their parities, at the size of row ``like``."""
        place, rows = self.tables[int(self.size[like])]
        among = among[place[among] >= 0]
        ones = np.zeros(rows.shape[1] * 64, np.int64)
        for k in range(0, len(among), block):
            ones += np.unpackbits(rows[place[among[k : k + block]]].view(np.uint8), axis=1).sum(0, dtype=np.int64)
        majority = np.packbits((2 * ones > len(among)).astype(np.uint8)).view(np.uint64)
        away = np.concatenate([np.bitwise_count(rows[place[among[k : k + block]]] ^ majority).sum(1) for k in range(0, len(among), block)])
        return int(among[np.argmin(away)])


def _scan(batches):
    forget_kept()
    sketch = np.zeros(SKETCH, np.int64)
    kind = None
    names = ["doc_id", "th", "n", "cls", "s2", "parity", "wide", "sketch"]
    for b in pieces(batches, "text", PIECE_BYTES):
        kind = b.column(0).type
        sets = shingle_sets(column(b, "text"))
        flat = np.concatenate(sets)
        sketch += np.bincount((flat & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        numbers = [pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [_signature(s) for s in sets], [_second(s) for s in sets])]
        bits = [pa.array(x, pa.binary()) for x in ([_parity(s, ROW_BITS) for s in sets], [_parity(s, PAIR_BITS) if len(s) > LONG else None for s in sets], [None] * len(sets))]
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "th"), *numbers, *bits], names)
    if kind is not None:
        total = pa.array([sketch.astype(np.uint32).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), *[pa.array([0], pa.int64())] * 2, *[pa.nulls(1, pa.binary())] * 2, total], names)


def _add_sketches(batches):
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            x = np.frombuffer(x, np.uint32 if len(x) == 4 * SKETCH else np.int64).astype(np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sketch"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all partitions' sketches, added up in a tree; 2 MB whatever the input."""
    n = rows.count()
    while True:
        n = max(1, -(-n // 8))
        rows = rows.repartition(n).mapInArrow(_add_sketches, "sketch binary")
        if n == 1:
            break
    total = np.zeros(SKETCH, np.int64)
    for (x,) in rows.collect():
        total += np.frombuffer(x, np.int64)
    return total


def _prefixes(sketch, need: int, twins: frozenset):
    """(shingle, class, n, position in rare-first order, whether for the star round) of each set's prefix; a copy seen just before is skipped."""

    def run(batches):
        seen, counts = {}, sketch.value
        for b in pieces(batches, "text", PIECE_BYTES):
            out = []
            for s in shingle_sets(column(b, "text")):
                if not len(s):
                    continue
                key = _signature(s, twins)
                if key in seen:
                    continue
                if len(seen) > 50_000:
                    seen.clear()
                seen[key] = None
                k = len(s) - -(-need * len(s) // 100) + 1
                order = np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:k]
                star = np.zeros(len(order), bool)
                star[np.argsort(mix(s[order]))[:STAR_SHINGLES]] = True
                out.append((s[order], key, len(s), star))
            if out:
                lengths = [len(x[0]) for x in out]
                yield pa.RecordBatch.from_arrays([longs(np.concatenate([x[0] for x in out])), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), lengths)), pa.array(np.repeat(np.array([x[2] for x in out], np.int32), lengths)), pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])), pa.array(np.concatenate([x[3] for x in out]))], ["token", "cls", "n", "pos", "star"])

    return run


def _shared_only(batches):
    """Rows of shingles that two classes have (sorted by shingle, class); repeats of a class go."""
    last_token = last_cls = None
    waiting = None  # the only row so far of the last shingle
    for b in batches:
        token, cls = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (np.diff(token) != 0) | (cls[1:] != cls[:-1])
        new[0] = not (token[0] == last_token and cls[0] == last_cls)
        keep = np.flatnonzero(new)
        if not len(keep):
            continue
        part = b.take(pa.array(keep))
        t = token[keep]
        with_before = np.zeros(len(t), bool)
        with_before[1:] = t[1:] == t[:-1]
        with_before[0] = t[0] == last_token
        with_next = np.zeros(len(t), bool)
        with_next[:-1] = t[1:] == t[:-1]
        if waiting is not None and with_before[0]:
            yield waiting
        take = np.flatnonzero(with_before | with_next)
        if len(take):
            yield part.take(pa.array(take))
        # The last row waits if nothing so far shares its shingle.
        waiting = None if with_before[-1] else part.slice(len(t) - 1)
        last_token, last_cls = t[-1], cls[keep[-1]]


def _fits(n1, p1, n2, p2, need: int):
    """Length and positional filters: could sets of these sizes that share a shingle at these places link?"""
    overlap = -(-need * (n1 + n2) // (100 + need))
    return (100 * np.minimum(n1, n2) >= need * np.maximum(n1, n2)) & (np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2) >= overlap)


class _Group:
    """Rows (token, cls, n, pos, comp, parity) of whole groups, ordered by token and n."""

    def __init__(self, batch: pa.RecordBatch, need: int):
        self.need = need
        values = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
        order = np.lexsort((values[2], values[0]))
        self.token, self.cls, self.n, self.pos, self.comp = (v[order] for v in values)
        self.first = np.flatnonzero(np.append(True, np.diff(self.token) != 0))
        self.end = np.append(self.first[1:], len(self.token))
        self.parities = _Parities(batch.column(5).take(pa.array(order)))

    def passing(self, i, j) -> np.ndarray:
        """Which of the pairs of rows i, j pass the length, positional and suffix filters."""
        i, j = np.broadcast_arrays(i, j)
        n1, n2 = self.n[i], self.n[j]
        ok = _fits(n1, self.pos[i], n2, self.pos[j], self.need)
        at = np.flatnonzero(ok)
        if len(at):
            n1, n2 = n1[at], n2[at]
            most = n1 + n2 - 2 * -(-self.need * (n1 + n2) // (100 + self.need))
            ok[at] = self.parities.distance(i[at], j[at]) <= most
        return ok

    def pairs(self, found: list) -> pa.RecordBatch:
        """Classes of the pairs of rows, each once."""
        at = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        got = np.unique(np.sort(np.stack([self.cls[at[0]], self.cls[at[1]]], 1), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])


def _stars(need: int):
    """Pairs of classes with the centres of their groups."""

    def run(batches):
        for b in whole_groups(batches, GROUP_ROWS):
            g = _Group(b, need)
            two = g.first[g.end - g.first == 2]
            two = two[g.passing(two, two + 1)]
            found = [np.stack([two, two + 1])]
            for first, end in zip(g.first.tolist(), g.end.tolist(), strict=True):
                left = np.arange(first, end)
                for _ in range(STAR_CENTRES if end - first > 2 else 0):
                    like = left[len(left) // 2]
                    near = left[100 * np.minimum(g.n[left], g.n[like]) >= need * np.maximum(g.n[left], g.n[like])]
                    centre = g.parities.nearest_to_majority(near, like)
                    other = left[left != centre]
                    ok = g.passing(other, centre)
                    found.append(np.stack([other[ok], np.full(ok.sum(), centre)]))
                    left = other[~ok]
                    if len(left) < 2:
                        break
            yield g.pairs(found)

    return run


def _undecided(need: int):
    """Rows whose group has a class of another component and a compatible length."""

    def run(batches):
        for b in whole_groups(batches, GROUP_ROWS):
            token, cls, n, pos, comp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            order = np.lexsort((n, token))
            token, n, comp = token[order], n[order], comp[order]
            group = np.cumsum(np.append(0, np.diff(token) != 0))
            change = np.append(True, (np.diff(group) != 0) | (np.diff(comp) != 0))
            run_first = np.flatnonzero(change)
            run_end = np.append(run_first[1:], len(token))
            of = np.cumsum(change) - 1
            key = (group << 32) + n
            low = np.searchsorted(key, (group << 32) + -(-need * n // 100))
            high = np.searchsorted(key, (group << 32) + 100 * n // need, side="right")
            keep = np.flatnonzero((low < run_first[of]) | (high > run_end[of]))
            if len(keep):
                yield b.take(pa.array(order[keep]))

    return run


def _between(need: int, forest: bool, most: int = 1 << 20):
    """Pairs of different components within each group that pass the filters: a spanning forest of them, or all."""

    def run(batches):
        for b in whole_groups(batches, GROUP_ROWS):
            g = _Group(b, need)
            _, label = np.unique(g.comp, return_inverse=True)
            parent = np.arange(label.max() + 1)

            def joins(i, j, parent=parent, label=label, g=g):
                """The pairs of rows to ask; in a forest only those that join what nothing joined before."""
                at = np.flatnonzero(parent[label[i]] != parent[label[j]])
                at = at[g.passing(i[at], j[at])]
                if forest and len(at):
                    kept = []
                    for k, x, y in zip(at.tolist(), label[i[at]].tolist(), label[j[at]].tolist(), strict=True):
                        while parent[x] != x:
                            x = parent[x]
                        while parent[y] != y:
                            y = parent[y]
                        if x != y:
                            parent[max(x, y)] = min(x, y)
                            kept.append(k)
                    while (parent[parent] != parent).any():
                        parent[:] = parent[parent]
                    at = np.array(kept, np.int64)
                return np.stack([i[at], j[at]])

            found, held = [], 0
            size = g.end - g.first
            small = np.repeat(size <= SMALL_GROUP, size)
            live = np.flatnonzero(small)
            for step in range(1, SMALL_GROUP):  # row i against row i + step, in all small groups at once
                live = live[live + step < len(g.token)]
                live = live[(g.token[live] == g.token[live + step]) & (100 * g.n[live] >= need * g.n[live + step])]
                if not len(live):
                    break
                found.append(joins(live, live + step))
            for first, end in zip(g.first[size > SMALL_GROUP].tolist(), g.end[size > SMALL_GROUP].tolist(), strict=True):
                comp = parent[label[first:end]]
                main = np.bincount(comp).argmax()
                rows = np.arange(first, end)
                minor = comp != main
                for i in rows[minor].tolist():  # each row outside the largest component against the block of compatible lengths
                    low, high = first + np.searchsorted(g.n[first:end], [-(-need * g.n[i] // 100), 100 * g.n[i] // need + 1])
                    other = rows[low - first : high - first]
                    other = other[(other > i) | ~minor[other - first]]
                    if len(other):
                        found.append(joins(np.full(len(other), i), other))
                        held += found[-1].shape[1]
                    if held > most:
                        yield g.pairs(found)
                        found, held = [], 0
            yield g.pairs(found)

    return run


def _wide_filter(need: int):
    """Pairs (a, b, na, nb, wa, wb) of long sets whose larger parities allow the overlap, and all others."""

    def run(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            at = np.flatnonzero(b.column(4).is_valid().to_numpy(zero_copy_only=False) & b.column(5).is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                n1, n2 = (b.column(i).to_numpy(zero_copy_only=False)[at] for i in (2, 3))
                both = _Parities(pa.concat_arrays([b.column(i).take(pa.array(at)) for i in (4, 5)]))
                k = np.arange(len(at))
                keep[at] = both.distance(k, k + len(at)) <= n1 + n2 - 2 * -(-need * (n1 + n2) // (100 + need))
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(documents, classes, twins: frozenset):
    """(class, set) of the documents that may be asked for, each class once in a piece of text."""

    def run(batches):
        for b in pieces(batches, "text", PIECE_BYTES):
            want = np.flatnonzero(in_bitmap(documents.value, column(b, "h").to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(want):
                sets = {_signature(s, twins): s for s in shingle_sets(column(b, "text").take(pa.array(want))) if len(s)}
                keys = np.fromiter(sets, np.int64, len(sets))
                keys = keys[in_bitmap(classes.value, keys.view(np.uint64))]
                data = [sets[k] for k in keys.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys), packed_binary(b"".join(s.tobytes() for s in data), 8 * np.cumsum([len(s) for s in data]))], ["cls", "items"])

    return run


def _verify(need: int):
    def run(batches):
        for b in batches:
            hit = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= need * (len(x) + len(y) - shared):
                    hit.append(i)
            yield b.select(["a", "b"]).take(pa.array(hit, pa.int64()))

    return run


def _classified(docs: DataFrame, similarity: int) -> DataFrame:
    """doc_id, th (hash of the text), n, component, least (struct of no_id, doc_id, th: the component's first document)."""
    with scratch() as keep:
        return cut(_components_of(docs, similarity, keep))


def _components_of(docs: DataFrame, similarity: int, keep) -> DataFrame:
    kind = id_type(docs)
    base = narrow(docs, "doc_id", "text").withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    spark = docs.sparkSession
    scanned = keep(base.mapInArrow(_scan, f"doc_id {kind}, th long, n long, cls long, s2 long, parity binary, wide binary, sketch binary"))
    sketch = shared_bytes(spark, _sketch(scanned.filter("sketch is not null").select("sketch")))
    rows = scanned.filter("sketch is null")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = keep(rows.filter("n > 0").groupBy("n", "cls", "s2").agg(F.min(first).alias("rep"), F.min("parity").alias("parity"), F.min("wide").alias("wide")))
    # Different sets of one 64-bit hash: n^2 / 2^65 pairs are expected of n classes, so less than one below 6 * 10^9.
    twins = frozenset(r[0] for r in passing(classes.groupBy("cls").count().filter("count > 1")).collect())
    if twins:
        own = F.when(F.col("cls").isin(list(twins)), F.col("s2")).otherwise(F.col("cls"))
        classes, rows = classes.withColumn("cls", own), rows.withColumn("cls", own)
    schema = "token long, cls long, n int, pos int, star boolean"
    shared = keep(
        base.select("text").mapInArrow(_prefixes(sketch, similarity, twins), schema)
        .repartition("token").sortWithinPartitions("token", "cls").mapInArrow(_shared_only, schema)
    )
    forget(sketch)
    parities = classes.select("cls", "parity")
    links = asked = None
    comp = spark.createDataFrame([], "node long, component long")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``: each class' set meets each of its pairs once, however many rows it has."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes, "cls").select("cls", F.xxhash64("rep.doc_id").alias("h"))
        wanted = [shared_bytes(spark, x) for x in bitmaps(named, "h", "cls")]
        items = base.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(_sets(*wanted, twins), "cls long, items binary").groupBy("cls").agg(F.first("items").alias("items"))
        both = pairs.join(items.withColumnsRenamed({"cls": "b", "items": "y"}), "b").join(items.withColumnsRenamed({"cls": "a", "items": "x"}), "a")
        out = keep(both.select("a", "b", "x", "y").mapInArrow(_verify(similarity), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")))
        forget(*wanted)
        return out

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
        sides = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "wa", "wb")
        return sides.mapInArrow(_wide_filter(similarity), "a long, b long")

    shape = ["token", "cls", "n", "pos"]
    rows_at = shared
    for finder in (_stars(similarity), _between(similarity, True), _between(similarity, False)):
        if links is None:
            full = shared.filter("star").withColumn("comp", F.col("cls"))
        else:
            at = rows_at.select(*shape).join(comp, F.col("cls") == F.col("node"), "left").select(*shape, F.coalesce("component", "cls").alias("comp"))
            full = rows_at = keep(at.repartition("token").sortWithinPartitions("token").mapInArrow(_undecided(similarity), "token long, cls long, n int, pos int, comp long"))
            if rows_at.isEmpty():  # every group is one component, or has no compatible lengths left
                break
        full = full.join(parities, "cls").select(*shape, "comp", "parity")
        pairs = full.repartition("token").sortWithinPartitions("token").mapInArrow(finder, "a long, b long").distinct()
        pairs = keep(pairs) if asked is None else keep(likely(keep(pairs.join(asked, ["a", "b"], "left_anti"))))
        asked = pairs if asked is None else asked.unionByName(pairs)
        new = verified(pairs)
        links = new if links is None else links.unionByName(new)
        comp = components(links, keep)
    named = classes.join(comp, classes.cls == comp.node, "left").select("n", "cls", "s2", "rep", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    of = named.join(least, "component").select(F.col("n").alias("cn"), F.col("cls").alias("ccls"), F.col("s2").alias("cs2"), "component", "least")
    out = rows.join(of, (F.col("cls") == F.col("ccls")) & (F.col("s2") == F.col("cs2")) & (F.col("n") == F.col("cn")), "left")
    return out.select("doc_id", "th", "n", "component", "least")


def near_duplicates(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id per row of ``docs`` (doc_id, text); ``similarity`` in hundredths.

    Null or empty texts, and texts without words: an empty set, linked with nothing, component_id is the
    row's own doc_id. Texts of fewer than five words: one shingle, the whole sequence. Rows with equal sets
    (repeated rows too) are one class and linked. Rows that share a doc_id but not a set are judged apart.
    A null doc_id counts for links but never names a component unless no member has an id. Ties cannot
    occur: links are symmetric and the least id names a component. Other columns are ignored.
    """
    return _classified(docs, similarity).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the least doc_id (of equal ids, the one whose text
    has the least hash). Documents without a word stay, each once; repeated rows stay once.

    Only documents that go or are repeated are joined with their verdicts; a bitmap of fixed size lets the others pass.
    """
    rows = _classified(docs, similarity)
    gone = (F.col("n") > 0) & ~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th")))
    marked = rows.groupBy(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).agg(F.bool_or(gone).alias("gone_"), F.count("*").alias("rows_")).filter("gone_ or rows_ > 1")
    marked = cut(marked.select("id_", "th_", "gone_", F.xxhash64("id_", "th_").alias("key_")))
    drop(rows)
    own = docs.withColumns({"own_id_": docs["doc_id"], "own_th_": F.xxhash64(F.coalesce(docs["text"], F.lit("")))}).withColumn("own_key_", F.xxhash64("own_id_", "own_th_"))
    some, others = split_by_bitmap(own, "own_key_", bitmap_chunks(marked, "key_"))
    stay = some.join(marked, F.col("own_id_").eqNullSafe(F.col("id_")) & (F.col("own_th_") == F.col("th_")), "left").filter("gone_ is null or not gone_").dropDuplicates(["own_id_", "own_th_"])
    return stay.select(*docs.columns).unionByName(others.select(*docs.columns))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: all pairs that share a shingle, then components by recursion.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END, ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
