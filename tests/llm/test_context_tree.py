"""Context-tree weighting and the word base against plain Python."""

import re
import zlib
from collections import Counter, defaultdict
from math import exp, lgamma, log, log1p, log10, pi

import pytest

from tallywood.llm import context_tree

TEXTS = [f"word{i % 5} the {'the cat' if i % 3 else 'Thé  dog'} {i}" for i in range(24)] + ["", None, "unseen words only", "the the the"]


def kt(a, b):
    return lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)


class Tree:
    """Weighted probabilities of all contexts of up to ``depth`` bytes, by recursion over their children."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, node, bit in self.decisions(t):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], node][bit] += 1
                    if d:
                        self.children[context[depth - d + 1 :], node].add(context[depth - d :])
        self.known = {}

    def decisions(self, text):
        data = bytes([context_tree.PAD]) * self.depth + (text or "").encode().lower() + bytes([context_tree.END])
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield data[i - self.depth : i], (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1

    def weighted(self, context, node):
        key = context, node
        if key not in self.known:
            own = kt(*self.counts.get(key, (0, 0)))
            if len(context) < self.depth:
                below = sum(self.weighted(c, node) for c in self.children.get(key, ()))
                high = max(own, below)
                own = high + log1p(exp(min(own, below) - high)) - log(2)
            self.known[key] = own
        return self.known[key]

    def chance(self, context, node, bit):
        """Of the decision, mixed from the longest context up."""
        p = None
        for d in range(self.depth, -1, -1):
            own = context[self.depth - d :]
            counts = self.counts.get((own, node), (0, 0))
            estimate = (counts[bit] + 0.5) / (sum(counts) + 1)
            stop = exp(kt(*counts) - log(2) - self.weighted(own, node))
            p = estimate if p is None else stop * estimate + (1 - stop) * p
        return p

    def score(self, text):
        return sum(log10(self.chance(*x)) for x in self.decisions(text))


@pytest.mark.parametrize(("depth", "hot"), [(2, 1 << 20), (3, 5), (4, 10), (6, 50)])
def test_scores_against_plain_recursion(spark, depth, hot):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    train = [t for t, h in zip(TEXTS, held, strict=True) if not h]
    tree = Tree(train, depth)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in context_tree.score_documents(df, hot_words=2, hot_pairs=hot, depth=depth).collect()}
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), None] for t in TEXTS]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    total = sum(counts.values())
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), total)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 1) / (total + 1 * (len(counts) + 1))) for w in tokens[i]))
        assert r["score"] == pytest.approx(tree.score(t), rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-tree.score(t) * log(10) / log(2) / (len((t or "").encode()) + 1))


@pytest.mark.parametrize("depth", [2, 4])
def test_chances_of_all_bytes_add_up_to_one(depth):
    """Of the full model, depth 0 included."""
    tree = Tree(TEXTS, depth)
    for context in (b"the "[-depth:], b"\xfe" * depth, b"qqqq"[:depth]):
        whole = 0.0
        for byte in range(256):
            p = 1.0
            for k in range(8):
                p *= tree.chance(context, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1)
            whole += p
        assert whole == pytest.approx(1)


def test_without_training_every_decision_is_even(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in context_tree.score_documents(df, F.lit(True)).collect()}
    assert got[1]["bits_per_byte"] == pytest.approx(8) and got[1]["train_tokens"] == 0 and got[2]["score"] == pytest.approx(8 * log10(0.5))
