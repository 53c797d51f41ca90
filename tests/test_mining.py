import itertools
import math
import random

import pytest

from tallywood.__main__ import parsed
from tallywood.config import ExperimentConfig, MiningConfig
from tallywood.functions import clamped_log, difference, existential_probability, is_proper_subset, itemset_line, jaccard, parse_itemset_line
from tallywood.operators import mine as mining
from tallywood.operators.experiment import run_experiment
from tallywood.operators.joins import extend, single_rows
from tallywood.operators.mine import mine, sweep
from tallywood.operators.prepare import item_bounds, item_ranks, itemset_in_transactions, measures, sort_by_rank, transaction_utilities, utility_rows
from tallywood.operators.prune import prune_pairs
from tallywood.operators.reports import Profiler, console_lines, summary, write_results_csv
from tallywood.operators.statistics import Statistics
from tallywood.operators.topk import contains, violations, would_accept
from tallywood.sources import read_profits, read_transactions, validate
from pyspark.sql import functions as F

DEMO = ["1:2:0.8 2:1:0.6 3:3:0.9", "1:1:0.7 4:2:0.95 5:1:0.4", "2:2:0.5 3:1:0.8 4:1:0.9"]
DEMO_PROFITS = ["1 5.0", "2 -2.0", "3 3.0", "4 8.0", "5 -1.0"]
LOSSY = ["1:10:1.0 2:1:1.0", "1:1:1.0 2:1:1.0 3:100:1.0", "3:2:1.0", "4:95:1.0", "5:95:1.0", "6:95:1.0", "7:95:1.0"]
LOSSY_PROFITS = ["1 -1.0", "2 0.5", "3 1.0", "4 1.0", "5 1.0", "6 1.0", "7 1.0"]


def tables(spark, lines, profits):
    tx = [(t, int(i), int(q), float(p)) for t, line in enumerate(lines, 1) for i, q, p in (e.split(":") for e in line.split())]
    return spark.createDataFrame(tx, "tid long, item int, qty long, prob double"), spark.createDataFrame([(int(i), float(p)) for i, p in map(str.split, profits)], "item int, profit double")


def brute(tx, profits, k, min_p):
    by = {}
    for t, i, q, p in tx:
        if i in profits and p > 1e-10:
            by.setdefault(t, {})[i] = (profits[i] * q, p)
    found = []
    items = sorted({i for b in by.values() for i in b})
    for n in range(1, len(items) + 1):
        for x in itertools.combinations(items, n):
            eu, none, some = 0.0, 1.0, False
            for b in by.values():
                if all(i in b for i in x):
                    p = math.prod(b[i][1] for i in x)
                    eu, none, some = eu + sum(b[i][0] for i in x) * p, none * (1 - p), True
            if some and eu >= -1e-10 and 1 - none >= min_p - 1e-10:
                found.append((list(x), eu, 1 - none))
    return sorted(found, key=lambda r: (-round(r[1], 6), -round(r[2], 6), len(r[0]), r[0]))[:k]


def same(result, expected):
    rows = result.orderBy("rank").collect()
    assert [r["items"] for r in rows] == [e[0] for e in expected]
    for r, e in zip(rows, expected, strict=True):
        assert r["eu"] == pytest.approx(e[1], abs=1e-6) and r["ep"] == pytest.approx(e[2], abs=1e-6) and r["size"] == len(e[0])


@pytest.mark.parametrize("strategy", ["BFS", "powerset", "DFS"])
def test_demo(spark, strategy):
    tx, pf = tables(spark, DEMO, DEMO_PROFITS)
    out = mine(tx, pf, MiningConfig(5, 0.3, strategy))
    assert [(r["items"], round(r["eu"], 4), round(r["ep"], 4)) for r in out.orderBy("rank").collect()] == [([4], 22.4, 0.995), ([1, 4], 13.965, 0.665), ([1, 3], 13.68, 0.72), ([1], 11.5, 0.94), ([3], 10.5, 0.98)]
    assert mine(tx, pf, MiningConfig(100, 0.0, strategy)).count() == 14


@pytest.mark.parametrize("strategy", ["levelwise", "powerset", "prefix"])
def test_sound_bound_keeps_the_lossy_case(spark, strategy):
    tx, pf = tables(spark, LOSSY, LOSSY_PROFITS)
    out = mine(tx, pf, MiningConfig(5, 0.1, strategy)).orderBy("rank").collect()
    assert [r["items"] for r in out] == [[3], [2, 3], [1, 2, 3], [1, 3], [4]] and all(r["ep"] == 1 for r in out)


def test_random_databases(spark):
    rnd = random.Random(5)
    for _ in range(3):
        profits = {i: rnd.randint(1, 9) * (-1 if i % 3 == 0 else 1) for i in range(1, 8)}
        tx = [(t, i, rnd.randint(1, 4), round(rnd.uniform(0.2, 1), 2)) for t in range(10) for i in rnd.sample(range(1, 8), rnd.randint(1, 6))]
        df, pf = spark.createDataFrame(tx, "tid long, item int, qty long, prob double"), spark.createDataFrame([(i, float(p)) for i, p in profits.items()], "item int, profit double")
        for strategy in ("levelwise", "powerset", "prefix"):
            same(mine(df, pf, MiningConfig(5, 0.1, strategy)), brute(tx, profits, 5, 0.1))


def test_edges(spark):
    tx, pf = tables(spark, ["1:1:1.0 2:1:0.0 9:5:0.5"], ["1 1.0", "2 3.0"])
    assert [(r["items"], r["ep"]) for r in mine(tx, pf, MiningConfig(5, 0.1)).collect()] == [([1], 1.0)]
    assert transaction_utilities(tx, pf).first()["ptu"] == 4  # an item of probability 0 counts
    assert {r["item"]: r["ptwu"] for r in item_bounds(tx, pf).collect()} == {1: 4}
    tx, pf = tables(spark, DEMO, ["1 -1.0", "2 -1.0", "3 -1.0"])
    assert mine(tx, pf).count() == 0
    with pytest.raises(ValueError):
        MiningConfig(k=0)
    with pytest.raises(ValueError):
        validate(tx.limit(0), pf)


def test_readers(spark, tmp_path):
    path = tmp_path / "tx.txt"
    path.write_text("# note\n\n1:1:0.5 1:2:0.6\n1:1:0.5 2:x:0.5\n1:1:1.2 3:1:0.5\n4:0:0.5\n5:1\n")
    got = lambda **k: sorted((r["item"], r["qty"], r["prob"]) for r in read_transactions(spark, str(path), **k).collect())
    assert got() == [(1, 2, 0.6), (4, 0, 0.5)]
    assert got(on_error="skip_entry", require_positive_qty=True) == [(1, 1, 0.5), (1, 2, 0.6), (3, 1, 0.5)]
    with pytest.raises(ValueError):
        got(on_error="fail")
    other = tmp_path / "pf.txt"
    other.write_text("1 5\nbad line here\n2 x\n1 7\n")
    assert [tuple(r) for r in read_profits(spark, str(other)).collect()] == [(1, 7.0)]


def test_algebra_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert tuple(df.select(jaccard("a", "b"), is_proper_subset("a", "b")).first()) == (pytest.approx(1 / 3), False)
    assert spark.createDataFrame([(0.0,), (-0.5,)], "logp double").agg(existential_probability()).first()[0] == 1.0
    tx, pf = tables(spark, DEMO, DEMO_PROFITS)
    out = mine(tx, pf, MiningConfig(5, 0.3))
    assert tuple(violations(out, 5, 0.3).first()) == (0, 0, 0, 0)
    line = out.select(itemset_line().alias("l")).select(parse_itemset_line(F.col("l")).alias("p")).select("p.*").collect()
    assert [4] in [r["items"] for r in line]
    write_results_csv(out, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).filter("rank = 2").first()["items"] == "[1, 4]"
    profiler = Profiler()
    with profiler.component("SEARCH"):
        assert "1. {4} EU=22.4000 EP=0.9950" in console_lines(out)
    assert "SEARCH" in summary(MiningConfig(5, 0.3), out, profiler)
    assert sweep(tx, pf, [2, 3], [0.3]).count() == 5


@pytest.mark.parametrize("strategy", ["levelwise", "powerset", "prefix"])
def test_ties_within_the_rounding(spark, strategy):
    """{1} has the larger EU by less than the rounding, {2} the larger EP: the tie goes to {2}, whatever the strategy."""
    tx, pf = tables(spark, ["1:1:0.5", "2:1:0.9 3:1:1.0", "2:1:0.5 3:1:1.0"], ["1 20.0000006", "2 -1.0", "3 6.2857142"])
    both = [((tuple(r["items"])), round(r["eu"], 6), round(r["ep"], 6)) for r in mine(tx, pf, MiningConfig(3, 0.0, strategy)).orderBy("rank").collect()]
    assert both[0] == ((3,), 12.571428, 1.0)
    tx, pf = tables(spark, ["1:1:0.5", "2:10:0.9 3:1:0.9", "2:1:0.05 3:1:0.05"], ["1 20.0000006", "2 0.1", "3 11.2"])
    rows = mine(tx, pf, MiningConfig(100, 0.0, strategy)).collect()
    best = sorted(rows, key=lambda r: (-round(r["eu"], 6), -round(r["ep"], 6), r["size"], r["items"]))
    for k in range(1, len(rows) + 1):
        assert [r["items"] for r in mine(tx, pf, MiningConfig(k, 0.0, strategy)).orderBy("rank").collect()] == [r["items"] for r in best[:k]]


def test_small_limits_give_the_same_answer(spark, monkeypatch):
    """Split prefixes, transactions too long for subsets, tables that do not travel."""
    rnd = random.Random(9)
    profits = {i: rnd.randint(1, 9) * (-1 if i % 4 == 0 else 1) for i in range(1, 9)}
    tx = [(t, i, rnd.randint(1, 4), round(rnd.uniform(0.2, 1), 2)) for t in range(12) for i in rnd.sample(range(1, 9), rnd.randint(2, 7))]
    df, pf = spark.createDataFrame(tx, "tid long, item int, qty long, prob double"), spark.createDataFrame([(i, float(p)) for i, p in profits.items()], "item int, profit double")
    want = brute(tx, profits, 8, 0.2)
    monkeypatch.setattr(mining, "SMALL_TABLE", 0)
    same(mine(df, pf, MiningConfig(8, 0.2)), want)
    monkeypatch.setattr(mining, "MOST_SUBSETS", 3)
    same(mine(df, pf, MiningConfig(8, 0.2, "powerset")), want)
    for rows in (30, 3):
        monkeypatch.setattr(mining, "GROUP_ROWS", rows)
        same(mine(df, pf, MiningConfig(8, 0.2, "prefix")), want)
    same(mine(df, pf, MiningConfig(8, 0.2, policy="EU_Focused")), want)
    same(mine(df, pf, MiningConfig(8, 0.2, pair_prune=True)), want)


def test_caches_are_freed(spark):
    tx, pf = tables(spark, DEMO, DEMO_PROFITS)
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for strategy in ("levelwise", "powerset", "prefix"):
        mine(tx, pf, MiningConfig(5, 0.3, strategy)).collect()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_ranks_pairs_and_itemsets(spark):
    tx, pf = tables(spark, DEMO, DEMO_PROFITS)
    ranks = item_ranks(item_bounds(tx, pf))
    by = {r["item"]: r["ptwu"] for r in ranks.collect()}
    assert [r["item"] for r in ranks.orderBy("rank").collect()] == sorted(by, key=lambda i: (round(by[i], 6), i)) and sorted(r["rank"] for r in ranks.collect()) == list(range(5))
    some = spark.createDataFrame([(9,), (1,), (3,)], "item int")
    assert [r["item"] for r in sort_by_rank(some, ranks).collect()][-1] == 9
    rows = utility_rows(tx, pf)
    three = measures(extend(extend(single_rows(rows), rows), rows), "items")
    pairs = spark.createDataFrame([(1, 3, 9.0), (1, 2, 9.0), (2, 3, 1.0), (1, 4, 9.0), (4, 5, 9.0), (1, 5, 9.0)], "i1 int, i2 int, bound double")
    assert {tuple(r["items"]) for r in three.collect()} == {(1, 2, 3), (1, 4, 5), (2, 3, 4)}
    assert {tuple(r["items"]) for r in prune_pairs(three, pairs, 5.0).collect()} == {(1, 4, 5)}
    got = {r["tid"]: (r["contained"], r["utility"], round(r["prob"], 6), r["logp"]) for r in itemset_in_transactions(tx, pf, [3, 1]).collect()}
    assert got == {1: (True, 19.0, 0.72, pytest.approx(math.log(0.72))), 2: (False, 5.0, 0.0, -700.0), 3: (False, 3.0, 0.0, -700.0)}
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "prob double").select(clamped_log()).collect()] == [-700.0, 0.0, pytest.approx(math.log(0.5))]
    assert spark.createDataFrame([([1, 2, 3], [2])], "a array<int>, b array<int>").select(difference("a", "b")).first()[0] == [1, 3]


def test_experiment_and_command_line(spark, tmp_path):
    (tmp_path / "tx.txt").write_text("\n".join(DEMO))
    (tmp_path / "pf.txt").write_text("\n".join(DEMO_PROFITS))
    run, cfg, verbose = parsed([str(tmp_path / "tx.txt"), str(tmp_path / "pf.txt"), "5", "0.3", "-o", str(tmp_path / "out"), "-n", "demo", "-r", "2", "--export-stats", "-d", "-v"])
    assert verbose and cfg == MiningConfig(5, 0.3) and run.repetitions == 2
    done = run_experiment(spark, run, cfg)
    assert len(done.seconds) == 2 and set(done.files) == {"results.csv", "profile.csv", "summary.txt", "results.txt", "stats.txt", "detailed.txt"}
    text = {k: open(p).read() for k, p in done.files.items()}
    assert text["results.csv"].splitlines()[:3] == ["rank,items,expected_utility,existential_probability,size", '1,"[4]",22.400000,0.995000,1', '2,"[1, 4]",13.965000,0.665000,2']
    assert text["results.txt"].startswith("# ") and text["results.txt"].splitlines()[-1] == "5 | 3 | 10.500000 | 0.980000 | 1"
    assert "SEARCH" in text["profile.csv"] and "generated: " in text["summary.txt"] and "max_eu=22.400000" in text["stats.txt"] and "level,generated" in text["detailed.txt"]
    first = done.statistics.levels[0]
    assert first["level"] == 1 and first["generated"] == 5 and first["generated"] == first["pruned_ep"] + first["pruned_bound"] + first["kept"]
    assert done.statistics.thresholds()[-1][1] == pytest.approx(10.5, abs=1e-5) and 0 <= done.statistics.effectiveness()["pruned"] <= 1
    assert contains(done.result, [4, 1]) and not contains(done.result, [5]) and would_accept(done.result, 5, 11.0) and not would_accept(done.result, 5, 9.0)
    cfg.save(str(tmp_path / "cfg.json"))
    assert parsed(["a", "b", "-c", str(tmp_path / "cfg.json"), "--max-depth", "2"])[1] == MiningConfig(5, 0.3, max_depth=2)
    (tmp_path / "none.txt").write_text("# nothing\n")
    with pytest.raises(ValueError):
        run_experiment(spark, ExperimentConfig(str(tmp_path / "tx.txt"), str(tmp_path / "none.txt")))
    with pytest.raises(ValueError):
        MiningConfig(policy="other")
    assert Statistics().breakdown()["generated"] == 0
