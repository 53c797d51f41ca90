import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallywood.llm import chroma_prints, context_tree, curve_packing, license_scan, line_dedup, ngram_join, piece_codec, quality_rules, substring_dedup, tag_paths
from tallywood.llm.common import components, split_words, tokenizer_path
from tallywood.llm.queries import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")
LONG = " ".join(f"w{i * i % 97}x{i}" for i in range(3000))
TEXTS = [
    None, "", " \n\t ", "a b", "a b", "All Rights Reserved. cc-by, general public license\nline two of the text is here for all to see", LONG, LONG, LONG + " tail",
    "one two three four five six seven eight nine ten eleven\none two three four five six seven eight nine ten other",
    "one two three four five six seven eight nine ten other", "é ß 日本 <s> İK ▁ x  y\x00",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 3 else "h", 0, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[5], (None, "no id here", "en", "h", 1, "c")], "doc_id long, text string, lang string, source string, n_chars long, th string")
    return df.select("*", F.lit(1).alias("cls"), F.lit(2).alias("id"), F.lit(3).alias("uid"), F.lit(4).alias("n_words"))


def test_every_operator_takes_awkward_rows(spark, docs):
    n = docs.count()
    pages = lambda d: tag_paths.extract(d.withColumnsRenamed({"doc_id": "page_id", "lang": "url", "text": "html"}))
    media = lambda d: chroma_prints.fingerprints(d.withColumn("media", F.col("text").cast("binary")), "doc_id", "media")
    for make in (license_scan.scan, quality_rules.verdicts, piece_codec.encode_and_decode, ngram_join.near_duplicates, line_dedup.dedup_lines, substring_dedup.remove_repeated_windows, context_tree.score_documents, pages, media):
        assert make(docs).count() == n, make
        assert make(docs.limit(0)).count() == 0, make
    assert curve_packing.pack(docs).agg(F.countDistinct("doc_id")).first()[0] == len(TEXTS)
    assert curve_packing.pack(docs.limit(0)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_near_duplicates(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got[3] == (1, 3) and got[4] == (1, 3) and got[0] == (0, 0) and got[1] == (0, 1)
    assert got[6][1] == got[7][1] == got[8][1] == 6 and got[10][1] == 10


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 80 * (len(x) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def test_near_duplicates_against_brute_force(spark):
    """Groups of edited copies (near their source, often not near each other), chains of copies, passages in common."""
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(4000)]
    fresh = lambda n: rng.choice(words, n).tolist()
    texts = []
    for n, edits, copies in ((300, 5, 60), (300, 8, 60), (60, 1, 50), (1500, 40, 25), (12, 1, 40), (200, 12, 40)):
        source = fresh(n)
        for _ in range(copies):
            w = list(source)
            for at in rng.integers(0, n, edits):
                w[at] = fresh(1)[0]
            texts.append(w)
        texts.append(source)
    chain = fresh(250)
    for _ in range(40):
        chain = [*chain[6:], *fresh(6)]
        texts.append(chain)
    passage = fresh(70)
    texts += [fresh(int(rng.integers(5, 200))) + passage + fresh(int(rng.integers(1, 100))) for _ in range(60)]
    texts = [" ".join(texts[i]) for i in rng.permutation(len(texts))]
    got = ngram_join.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(texts)


def test_a_class_is_verified_once_however_many_rows_it_has(spark, monkeypatch):
    """Two near texts, each repeated in many rows of its id and under other ids: one pair of sets is compared."""
    words = [f"t{i}" for i in range(60)]
    a, b = " ".join(words), " ".join([*words[:-1], "other"])
    met = []
    verify = ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda need: met.append(need) or verify(need))
    counted = spark.sparkContext.accumulator(0)

    def counting(need):
        inner = verify(need)

        def run(batches):
            def seen():
                for x in batches:
                    counted.add(x.num_rows)
                    yield x

            yield from inner(seen())

        return run

    monkeypatch.setattr(ngram_join, "_verify", counting)
    rows = [(1, a)] * 30 + [(2, b)] * 30 + [(i, a) for i in range(3, 30)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got} == {1} and counted.value == 1


def test_class_keys_of_colliding_hashes():
    s = np.arange(9, dtype=np.uint64)
    assert ngram_join._signature(s, frozenset([ngram_join._signature(s)])) == ngram_join._second(s) != ngram_join._signature(s)


def test_keep_first_judges_texts_apart(spark):
    """Texts that share an id, repeated rows, texts without words."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b), (4, None), (4, ""), (5, "  "), (None, a + " more"), (None, "x y z")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = ngram_join.keep_first(docs)
    assert got.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "").strip()) for r in got.collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (4, ""), (5, ""), (None, "x y z")], key=repr)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, int(n))) for n in rng.integers(60, 2500, 60)]
    p = ngram_join._Parities(pa.array([ngram_join._parity(s, 11) for s in sets], pa.binary()))
    i, j = np.triu_indices(len(sets), 1)
    real = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    assert (p.distance(i, j) <= real).all() and p.distance(i, j).max() > 0


@pytest.mark.parametrize("most", [1 << 18, 50])
def test_components_of_chains_and_random_links(spark, most):
    """In one task, and by contraction and star steps."""
    rng = np.random.default_rng(6)
    links = [(i, i + 1) for i in range(1000, 1100)] + [(int(a), int(b)) for a, b in rng.integers(0, 900, (350, 2))] + [(5000 - i, 5000 - i - 1) for i in range(60)]
    root = {n: n for e in links for n in e}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {n: low if r == high else r for n, r in root.items()}
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long").repartition(7), most=most).collect()))
    assert {n: got.get(n, n) for n in root} == root


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11)], "u long, v long")
    assert {tuple(r) for r in components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10)}


def brute_windows(texts, k):
    words = [(t or "").split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - k + 1):
            seen[tuple(w[i : i + k])] = seen.get(tuple(w[i : i + k]), 0) + 1
    return [sum(any(seen[tuple(w[i : i + k])] > 1 for i in range(max(0, p - k + 1), min(p, len(w) - k) + 1)) for p in range(len(w))) for w in words]


@pytest.mark.parametrize("hot", [1 << 16, 1])
def test_repeated_windows_with_and_without_hot_minimisers(spark, hot):
    texts = ["a b c d e f g h i j", "x a b c d e f y", "q q q q q q q q q q", "a b c", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeated_windows(df, 5, 3, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_windows(texts, 5)


def test_line_dedup_keeps_the_earliest_of_near_lines(docs):
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got[3] == (1, 0) and got[4] == (1, 1) and got[6] == (1, 0) and got[7] == (1, 1) and got[8] == (1, 1) and got[9] == (2, 1) and got[10] == (1, 1) and got[0] == (1 - 1, 0)


def near_lines(x, y):
    """Whether one word edit makes the lines equal."""
    if abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    short, long = sorted((x, y), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_lines(texts, least=line_dedup.LEAST_WORDS):
    """Kept lines of each text: a line goes if an equal or near one stands earlier."""
    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if not w or not any(w == y or (min(len(w), len(y)) >= least and near_lines(w, y)) for y in seen):
                kept.append(line)
            if w:
                seen.append(w)
        out.append("\n".join(kept))
    return out


def test_line_dedup_against_brute_force(spark):
    """Lines of few different words, with words put in, left out and replaced, and repeated words."""
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 6, int(n))] for n in rng.integers(5, 14, 25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(4):
            w = list(base[rng.integers(0, len(base))])
            for _ in range(int(rng.integers(0, 4))):
                at, kind = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
                w[at : at + (kind > 0)] = [f"w{rng.integers(0, 9)}"] * (kind < 2)
            lines.append(" ".join(w))
        texts.append("\n".join([*lines, "", "  "][: rng.integers(3, 7)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (line_dedup.LEAST_WORDS, 2):
        got = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs, least).collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, least)


def test_license_spans_compete(spark):
    """Licenses that differ in a word, paragraphs from the middle of a license, words put in, and the Kelvin sign."""
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    mit = license_scan.TEMPLATES["mit"]
    texts = {
        cc.format("Attribution"): "cc-by", cc.format("Attribution-ShareAlike"): "cc-by-sa", cc.format("Attribution-NonCommercial"): "cc-by-nc", cc.format("Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        cc.format("Attribution") + " words between the two, " + cc.format("Attribution-ShareAlike"): "cc-by,cc-by-sa",
        mit[2].upper(): "mit", " ".join(mit[3].split()[:30] + ["really"] + mit[3].split()[30:]): "mit", license_scan.TEMPLATES["lgpl"][1]: "gpl,lgpl",
        "see https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa", "this wor\u212a is free software": "", "ALL rights-reserved, CC BY": "cc-by,reserved", None: "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    kelvin = "permission is hereby granted free of charge to any person ma\u212aing a copy of this software"
    assert license_scan.scan(spark.createDataFrame([(1, kelvin)], "doc_id long, text string")).first()["n_words"] == 16


def test_piece_codec_is_the_library(docs):
    sp = piece_codec.sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    for r in piece_codec.encode_and_decode(docs.filter("doc_id is not null")).collect():
        ids = sp.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == sp.decode(ids)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok, by, sequences = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}, {}
    for r in curve_packing.pack(docs.filter("doc_id is not null and doc_id <> 5"), 64).collect():
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, rows in by.items():
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(rows, key=lambda r: r["start"])])
        assert ids.tolist() == [*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
    for rows in sequences.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 64 and end & (end - 1) == 0


def test_hilbert_neighbours():
    cells = np.array([(x, y) for x in range(8) for y in range(8)])
    order = cells[np.argsort(curve_packing.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_split_words_is_bytes_split():
    texts = ["  A b\tc\n", "", None, "É x\x0bY"]
    distinct, index, counts = split_words(pa.array(texts, pa.string()), lower=True)
    words = distinct.to_pylist()
    flat, at = [words[i] for i in index], 0
    for t, n in zip(texts, counts, strict=True):
        assert flat[at : at + n] == [w.decode() for w in (t or "").encode().lower().split()]
        at += n


def own_line(i):
    return " ".join("".join(chr(97 + int(d)) for d in f"{i * 7919 + j:06d}") for j in range(12))


def test_quality_counts_documents_that_share_their_least_line(spark):
    """A banner whose md5 is less than that of nearly all lines; copies of one text count once."""
    banner = min((own_line(10**7 + i) for i in range(3000)), key=lambda x: hashlib.md5(x.encode()).digest())
    texts = [f"{own_line(i)}\n{banner}" for i in range(150)] + [f"{banner}\nx y"] + [own_line(999)] * 150
    rows = [(i, t, "h") for i, t in enumerate(texts)] + [(1000, f"{own_line(5000)}\n{banner}", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["boilerplate_words"], r["kept"]) for r in quality_rules.verdicts(docs).collect()}
    assert all(got[i] == (12, True) for i in range(150)) and got[150] == (12, False)
    assert all(got[i] == (0, True) for i in range(151, 301)) and got[1000] == (0, True)


def test_quality_keeps_different_lines_without_letters(spark):
    texts = ["\n".join([own_line(i), "* * *", *(f"{i} {j} | {i * j + 0.5}" for j in range(20))]) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in quality_rules.apply_rules(docs).collect()}
    assert got == {i: t.replace("* * *\n", "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("n", [600, 1200])
def test_quality_limit_is_a_share_of_the_host(spark, n):
    """A line in an eighth of a host's documents stays and one in three tenths goes, however large the host."""
    eighth, most = own_line(10**6), own_line(2 * 10**6)
    texts = ["\n".join([own_line(i), *[eighth] * (i % 8 == 0), *[most] * (i % 10 < 3)]) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in quality_rules.apply_rules(docs).collect()}
    assert got == {i: t.replace("\n" + most, "") for i, t in enumerate(texts)}


def test_queries_match_their_oracles_on_small_tables(spark):
    if not SF.exists():
        pytest.skip("no tables")
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in oracle_sql().items():
        df, q = queries()[name](spark, str(SF)), con.sql(sql)
        columns = sorted(df.columns)
        assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(q.project(", ".join(columns)).fetchall(), key=repr), name
