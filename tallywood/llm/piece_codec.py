"""SentencePiece-style merge (BPE) encoding and decoding by a prefix table.

For each prefix of a chunk the table stores the unique last token of that prefix's encoding. An automaton
over the vocabulary yields the tokens that end at a place; a token is the last one exactly if it is
compatible with the last token of the prefix before it, that is if no merge would cross their border. The ids
are then recovered backwards from the whole chunk's entry.

Texts are cut before each run of spaces that precedes other characters: no piece of the vocabulary reaches
from another character into a space, which is checked when the model is read (else whole texts are the
chunks). Chunks repeat, so their ids are remembered in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, binaries, id_type, kept_by_worker, narrow, pieces, tokenizer_path

SPACE = "▁"


class MergeVocabulary:
    """Pieces, the time of each one's making, and how each one is made."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.bytes_of: list[bytes] = []
        score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            elif sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                self.id_of[piece] = i
                score[piece] = sp.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        ranked = sorted(score.values(), reverse=True)
        place = {s: k for k, s in enumerate(ranked)}
        self.rank = {p: place[s] for p, s in score.items()}
        #: No piece joins another character to a following space, nor two spaces to anything else.
        self.splits_at_spaces = not any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.id_of)
        self.made: dict[str, tuple[str, str] | None] = {}
        self.time: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for p in sorted(self.id_of, key=lambda p: (self.rank[p], len(p))):
            if self.splits_at_spaces and not p.strip(SPACE) and len(p) > 1:
                continue  # runs of spaces have their own rule
            parts = self.merge(p, last=True)
            if parts is not None:  # else the piece cannot arise from its own text
                self.made[p] = parts or None
                self.time[p] = max([self.rank[p] if len(p) > 1 else -1, *(self.time.get(x, -1) for x in parts)])
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Neighbouring characters inside pieces: no merge ever crosses any other border.
        self.neighbours = {x for p in self.id_of for x in zip(p, p[1:], strict=False)}

    def merge(self, text: str, last: bool = False):
        """Plain merging, best score first, then leftmost: pieces, or with ``last`` the two that made the whole."""
        part: list[str | None] = list(text)
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (both := part[i] + part[j]) in self.rank:
                heapq.heappush(heap, (self.rank[both], i, both))

        for i in range(len(part) - 1):
            offer(i)
        made: tuple = ()
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) < 0 or part[i] + part[j] != both:
                continue
            made = (part[i], part[j])
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out = [p for p in part if p is not None]
        return out if not last else made if len(out) == 1 else None

    def spine(self, piece: str, side: int) -> list[tuple[int, str]]:
        """(time, piece) of the outermost pieces on one side, from the character up to the whole."""
        out = []
        while piece:
            out.append((self.time.get(piece, -1), piece))
            parts = self.made.get(piece)
            piece = parts[side] if parts else ""
        return out[::-1]

    def compatible(self, left: str, right: str) -> bool:
        """True if merging left + right ends with exactly these two: no merge crosses the border in time."""
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.spine(left, 1), self.spine(right, 0)
            i = j = 0
            known = True
            while True:
                rank = self.rank.get(a[i][1] + b[j][1])
                next_a = a[i + 1][0] if i + 1 < len(a) else 1 << 60
                next_b = b[j + 1][0] if j + 1 < len(b) else 1 << 60
                if rank is not None and rank < next_a and rank <= next_b:
                    known = False
                    break
                if next_a == next_b == 1 << 60:
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def prefix_table(self, chunk: str) -> list[str]:
        """Pieces of a chunk: last token of each prefix, then back from the end."""
        last: list[str] = [""] * len(chunk)  # a character outside the vocabulary stands alone
        pairs = self.pairs
        for end, piece in self.automaton.iter(chunk):  # for each end the longest first
            if last[end]:
                continue
            begin = end - len(piece)
            if begin >= 0:
                before = last[begin] or chunk[begin]
                known = pairs.get((before, piece))
                if not (self.compatible(before, piece) if known is None else known):
                    continue
            last[end] = piece
        out, end = [], len(chunk) - 1
        while end >= 0:
            piece = last[end] or chunk[end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def chunk_ids(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of one chunk: spaces, then other characters."""
        spaces = len(chunk) - len(chunk.lstrip(SPACE)) if self.splits_at_spaces else 0
        if spaces > 1 or spaces == len(chunk):
            # Merges of spaces score below all others: the last space joins the word first if it can.
            rest = self.prefix_table(chunk[spaces - 1 :])
            run = spaces - 1
            if rest[0] == SPACE:
                rest, run = rest[1:], spaces
            found = [*self.merge(SPACE * run), *rest]
        else:
            found = self.prefix_table(chunk)
        ids: list[int] = []
        for p in found:
            i = self.id_of.get(p)
            ids.extend([i] if i is not None else [self.byte_id[x] for x in p.encode()])
        return np.array(ids, "<u4").tobytes()


class PieceCodec(Remembered):
    """chunk -> ids."""

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = MergeVocabulary(path)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n") if self.vocabulary.splits_at_spaces and not any("\n" in x for x in self.vocabulary.neighbours) else re.compile("(?s).+")
        self.first, self.end = (np.array([x], "<u4").tobytes() for x in (self.vocabulary.bos, self.vocabulary.eos))

    def make(self, chunk: str) -> bytes:
        """Ids of a chunk, part by part where it has borders that no merge crosses."""
        near = self.vocabulary.neighbours
        cuts = [i for i, x in enumerate(zip(chunk, chunk[1:], strict=False), 1) if x not in near]
        if not cuts or chunk[0] == chunk[1:2] == SPACE:
            return self.vocabulary.chunk_ids(chunk)
        return b"".join([self[chunk[i:j]] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)])

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as bytes."""
        if not text:
            return self.first + self.end
        chunks = self.cut.findall(SPACE + text.replace(" ", SPACE))
        return self.first + b"".join(map(self.__getitem__, chunks)) + self.end

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, less the first one's leading space; ill-formed bytes become U+FFFD."""
        data = b"".join(map(self.vocabulary.bytes_of.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _coded(path: str):
    def run(batches):
        codec = kept_by_worker(path, lambda: PieceCodec(path))
        for b in pieces(batches, "text"):
            ids = [codec.encode((t or b"").decode("utf-8", "replace")) for t in binaries(b, "text")]
            decoded = [codec.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode_and_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded, per row of ``docs`` (doc_id, text).

    ``model``: a sentencepiece BPE model with byte fallback (by default the public 32k one). Null and empty
    texts: begin and end ids only, decoded is empty. Repeated rows and shared ids: one result each. Very long
    texts are coded whole. Other columns are ignored; there are no ties.
    """
    path = tokenizer_path("piece_bpe_32k.model", model)
    return narrow(docs, "doc_id", "text").mapInArrow(_coded(path), f"doc_id {id_type(docs)}, n_tokens long, ids binary, decoded string")


def op5_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    out = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
