import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


def test_oracles_have_queries():
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_part(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("tallywood", ".git", "tests"):  # corpus_pipeline.py stays, and cannot be imported
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tallywood").mkdir()
    for p in (REPO / "tallywood").iterdir():
        if p.name != "llm":
            (tmp_path / "tallywood" / p.name).symlink_to(p)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 30, out.stderr


def test_queries_match_oracles_on_the_small_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    from tallywood.plans.queries import oracle_sql, queries

    sf = Path("/root/testdata/sf0.001")
    if not sf.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("topk_mixed_levelwise", "topk_mixed_prefix", "pair_measures", "diffset_pairs", "prune_combined", "prune_extensions", "text_transactions", "stream_item_measures", "item_rank"):
        df, q = queries()[name](spark, str(sf)), con.sql(oracle_sql()[name])
        columns = sorted(df.columns)
        assert columns == sorted(q.columns)
        # Sums end in another order: values that lie on the border of a rounding may differ by it.
        order = lambda r: tuple((isinstance(v, float), v) for v in sorted(r, key=lambda v: (isinstance(v, float), repr(v))))
        want, got = (sorted(rows, key=order) for rows in (q.project(", ".join(columns)).fetchall(), [tuple(r) for r in df.select(*columns).collect()]))
        assert len(got) == len(want), name
        for g, w in zip(got, want, strict=True):
            assert all(x == pytest.approx(y, abs=1.01e-4) if isinstance(y, float) else x == y for x, y in zip(g, w, strict=True)), (name, g, w)
