"""The pipeline against plain Python, stage by stage."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_lines

import corpus_pipeline
from tallywood.llm import quality_rules
from tallywood.llm.common import tokenizer_path


def brute_quality(docs):
    """Rules on one text, and lines that too many different texts of a host have."""
    lines = {i: [x for x in (t or "").split("\n") if x.split()] for i, t, _ in docs}
    norm = lambda x: " ".join("".join(c if c.isalpha() else " " for c in x).lower().split()) if any(map(str.isalpha, x)) else " ".join(x.split())
    hosts, have = {}, {}
    for i, t, h in docs:
        hosts.setdefault(h, set()).add(t or "")
        for x in lines[i]:
            have.setdefault((h, norm(x)), set()).add(t)
    common = {k for k, v in have.items() if len(v) > quality_rules.LINE_LIMIT and len(v) > quality_rules.LINE_SHARE * len(hosts[k[0]])}
    out = []
    for i, t, h in docs:
        w = (t or "").split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        lost = sum(len(x.split()) for x in lines[i] if (h, norm(x)) in common)
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and len(w) - lost >= quality_rules.LEAST_KEPT * len(w):
            out.append((i, "\n".join(x for x in t.split("\n") if not x.split() or (h, norm(x)) not in common), h))
    return out


def brute_windows_removed(docs, k=35):
    seen = {}
    for _, t, _ in docs:
        w = t.split()
        for a in range(len(w) - k + 1):
            seen[tuple(w[a : a + k])] = seen.get(tuple(w[a : a + k]), 0) + 1
    out = []
    for i, t, h in docs:
        w = t.split()
        gone = {a + j for a in range(len(w) - k + 1) if seen[tuple(w[a : a + k])] > 1 for j in range(k)}
        out.append((i, " ".join(x for a, x in enumerate(w) if a not in gone), h))
    return out


def corpus():
    """Boilerplate of a host, equal and near lines, near and exact copies, shared passages, junk, nulls."""
    rng = np.random.default_rng(9)
    fresh = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(n))
    banner, passage = "All of this site, 12 of it, is our own work", fresh(60)
    docs = [(f"{fresh(12)}\n{banner}\n{fresh(40)}", "big") for _ in range(120)]
    docs += [(f"{fresh(4)}\n{banner}\n{banner}", "big") for _ in range(3)]
    docs += [(fresh(20), "big"), ("x " * 40, "small"), ("too few words", None), (None, "small"), ("", None)]
    for _ in range(6):
        w = fresh(150).split()
        docs.append((" ".join(w), "small"))
        w[70] = "changed"
        w[20] = "other"
        docs.append((" ".join(w), None))
    line = fresh(15)
    docs += [(f"{fresh(12)}\n{line}\n{fresh(9)}", "small"), (f"{fresh(12)}\n{line.rsplit(' ', 1)[0]}\n{fresh(9)}", None), (line, None)]
    docs += [(f"{fresh(int(n))} {passage} {fresh(30)}", "small") for n in rng.integers(20, 200, 8)]
    docs += [docs[5], docs[130]]
    return [(i, t, h) for i, (t, h) in enumerate(docs)]


def test_pipeline_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_quality(rows)
    kept = brute_lines([t for _, t, _ in want])
    want = [(i, t, h) for (i, before, h), t in zip(want, kept, strict=True) if t.split() or not before.split()]
    least = brute_components([t for _, t, _ in want])
    want = [d for at, d in enumerate(want) if least[at] == at]
    want = brute_windows_removed(want)
    assert 60 < len(want) < len(rows) - 10
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in docs.collect()) == sorted((i, t, h, len(t)) for i, t, h in want)
    tok, ids = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect():
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t, _ in want}


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs, "").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").isEmpty()


@pytest.mark.parametrize("n", [3000])
def test_packing_leaves_no_padding_and_keeps_neighbours_together(spark, n):
    """Documents of few topics: along the curve, neighbours share their topic far more often than by chance."""
    from tallywood.llm import curve_packing

    rng = np.random.default_rng(4)
    topics = [[f"{chr(97 + k)}{chr(97 + int(a))}{chr(97 + int(b))}" for a, b in rng.integers(0, 26, (30, 2))] for k in range(12)]
    docs = [(i, " ".join(rng.choice(topics[i % 12], 80))) for i in range(n)]
    out = curve_packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("sequence_id", "offset").select("doc_id", "sequence_id", "length", "offset").collect()
    size = {}
    for r in out:
        assert r["offset"] == size.get(r["sequence_id"], 0)
        size[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(s == 4096 or s & (s - 1) == 0 for s in size.values())
    order = list(dict.fromkeys(r["doc_id"] for r in out))
    same = np.mean([a % 12 == b % 12 for a, b in zip(order, order[1:], strict=False)])
    assert same > 3 / 12


def test_run_drops_what_is_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a{i} b c d e f g h i j k l m n{i}", "en", "s", 1) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id")).first()[0] == 3


def test_stages_leave_no_broadcasts_behind(spark):
    """Bitmaps of 16 MB each: a long session must not pile up their files on the driver's disk."""
    docs = spark.createDataFrame([(i, t, "en", h, 1) for i, t, h in corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    folder = Path(spark.sparkContext._temp_dir)
    before = {p: p.stat().st_size for p in folder.iterdir()}
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() < docs.count() and corpus_pipeline.passages(spark, docs, "").count() == docs.count()
    assert sum(p.stat().st_size for p in folder.iterdir() if p not in before) < 1_000_000
