"""Top-K expected-utility mining: three strategies with the same exact answer."""

from __future__ import annotations

from itertools import count
from math import comb

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..config import EPSILON, TIE, MiningConfig
from ..functions import existential_probability
from .joins import extend, single_rows
from .prepare import measures, ranked_rows, usable
from .prune import qualify
from .statistics import Statistics
from .store import kept
from .topk import least_of, ranked, top_k

#: Rows of a table that travels to all tasks; subsets of one transaction; rows of a prefix in one task; levels between checkpoints.
SMALL_TABLE, MOST_SUBSETS, GROUP_ROWS, KEEP_EVERY = 100_000, 1 << 18, 2_000_000, 3
FOUND = "items array<int>, eu double, ep double, size int"


def _persisted(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_TABLE else df


def _singles(rows: DataFrame) -> DataFrame:
    """Measures of each item; ``place``: its last place in any transaction."""
    return measures(rows, "item", "ptwu", place=F.max("rank")).withColumn("items", F.array("item"))


def _results(df: DataFrame, least: float, cfg: MiningConfig) -> DataFrame:
    return qualify(df, least, cfg.min_probability).select("items", "eu", "ep", F.size("items").alias("size"))


def _open(df: DataFrame, least: float, cfg: MiningConfig) -> DataFrame:
    """Itemsets that may have an extension in the answer."""
    out = df.filter(F.col("bound") >= least - EPSILON)
    return out.filter(F.col("ep") >= cfg.min_probability - EPSILON) if cfg.tests_probability else out


def levelwise(rows: DataFrame, cfg: MiningConfig, statistics: Statistics | None = None) -> DataFrame:
    """Itemsets of one item, two items ...: each level joins the survivors' lists with the items of higher rank.

    A level is computed by one action that brings the best k itemsets so far, k rows, to the driver; their k-th prunes
    the next level. With ``pair_prune``, from three items on a set's last pair must have a pair bound and a probability
    that suffice. Two levels are held at a time, and every third one is checkpointed, so that a lost executor costs
    three at most. ``rows`` are read several times: the caller caches them.
    """
    spark = rows.sparkSession
    singles, seen = _persisted(_singles(rows)), Observation()
    found = top_k(_results(singles.observe(seen, F.count("*").alias("n")), 0.0, cfg), cfg.k).collect()
    least, n = least_of(found, cfg.k), seen.get["n"]
    if statistics is not None:
        statistics.level(1, singles, least, cfg)
    entries = _persisted(rows.join(_sized(_later(singles, least, cfg), n), "item", "left_semi"))
    survivors = _open(singles, least, cfg).select("items")
    level, size, held, pairs = single_rows(entries), 1, [], None
    if cfg.pair_prune and n:
        pairs = _pairs(entries, least, cfg)
    while n and (not cfg.max_depth or size < cfg.max_depth):
        size += 1
        grown = extend(level.join(_sized(survivors, n), "items", "left_semi"), entries, pairs if size > 2 else None)
        grown = kept(grown) if size % KEEP_EVERY == 0 else _persisted(grown)
        judged = _persisted(measures(grown, "items"))
        # How many could survive by the threshold so far, learnt by the same action.
        seen = Observation()
        watched = judged.observe(seen, F.count_if(F.col("bound") >= least - EPSILON).alias("n"))
        before = spark.createDataFrame(found, FOUND)
        found = top_k(before.unionByName(_results(watched, least, cfg)), cfg.k).collect()
        least, n = least_of(found, cfg.k), seen.get["n"]
        if statistics is not None:
            statistics.level(size, judged, least, cfg)
        survivors = _open(judged, least, cfg).select("items")
        for df in held:
            df.unpersist()
        level, held = grown, [grown, judged]
    for df in (*held, entries, singles):
        df.unpersist()
    return spark.createDataFrame(found, FOUND)


def _later(singles: DataFrame, least: float, cfg: MiningConfig) -> DataFrame:
    """Items that may be added to a set: by probability and by the utility of their transactions."""
    out = singles.filter(F.col("ptwu") >= least - EPSILON)
    return (out.filter(F.col("ep") >= cfg.min_probability - EPSILON) if cfg.tests_probability else out).select("item")


def _pairs(entries: DataFrame, least: float, cfg: MiningConfig) -> DataFrame:
    """i1 < i2 of the pairs that a larger set in the answer may have, by the sum of ptu * P and by probability."""
    e = entries.select("tid", "item", "ptu", "logp")
    other = e.select(F.col("tid").alias("t"), F.col("item").alias("i2"), F.col("logp").alias("l2"))
    both = e.withColumnRenamed("item", "i1").join(other, (F.col("tid") == F.col("t")) & (F.col("i1") < F.col("i2"))).withColumn("l", F.col("logp") + F.col("l2"))
    judged = both.groupBy("i1", "i2").agg(F.sum(F.col("ptu") * F.exp("l")).alias("bound"), existential_probability("l").alias("ep"))
    good = kept(_open(judged, least, cfg).select("i1", "i2"))
    return _sized(good, good.count())


def powerset(rows: DataFrame, cfg: MiningConfig) -> DataFrame:
    """All subsets of each transaction up to ``max_depth`` items, one aggregation; for short transactions.

    Where a transaction has more than ``MOST_SUBSETS`` of them, learnt by the same action, the levelwise search gives
    the answer instead.
    """
    entry, seen = F.struct("item", "u", "logp"), Observation()
    subsets_of = lambda n: sum(comb(n, i) for i in range(1, min(cfg.max_depth or n, n) + 1))
    most = next(n for n in count() if subsets_of(n + 1) > MOST_SUBSETS)
    baskets = rows.groupBy("tid").agg(F.sort_array(F.collect_list(entry)).alias("b")).observe(seen, F.count_if(F.size("b") > most).alias("long"))
    baskets = baskets.filter(F.size("b") <= most)
    none = F.array(F.struct(F.array().cast("array<int>").alias("items"), F.lit(0.0).alias("u"), F.lit(0.0).alias("logp")))
    grow = lambda s, x: F.struct(F.array_append(s["items"], x["item"]).alias("items"), (s["u"] + x["u"]).alias("u"), (s["logp"] + x["logp"]).alias("logp"))
    open_sets = lambda acc: F.filter(acc, lambda s: F.size(s["items"]) < cfg.max_depth) if cfg.max_depth else acc
    sets = F.aggregate("b", none, lambda acc, x: F.concat(acc, F.transform(open_sets(acc), lambda s: grow(s, x))))
    subsets = baskets.select(F.explode(sets).alias("s")).select("s.items", "s.u", "s.logp", F.lit(0.0).alias("rem")).filter(F.size("items") > 0)
    found = top_k(_results(measures(subsets, "items"), 0.0, cfg), cfg.k).collect()
    return levelwise(_persisted(rows), cfg) if seen.get["long"] else rows.sparkSession.createDataFrame(found, FOUND)


def _search(k: int, min_probability: float, max_depth: int, least: float):
    """Depth-first search below one prefix, over the later items of its transactions.

    Rows: head, second (or null), tid, item, ptwu, u, rem, logp of a later item, pu and pl of the prefix there.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        floor = least
        tids, index = np.unique(pdf["tid"].to_numpy(), return_inverse=True)
        lists = []
        for (_, item), at in sorted(pdf.assign(order=pdf["ptwu"].round(6)).groupby(["order", "item"]).indices.items()):
            lists.append((int(item), index[at], *(pdf[c].to_numpy()[at] for c in ("u", "rem", "logp"))))
        prefix = [int(x) for x in pdf[["head", "second"]].iloc[0] if not pd.isna(x)]

        def visit(items: list, at: int, tid, u, rem, logp) -> None:
            nonlocal floor, out
            p = np.exp(logp)
            ep = 1.0 if p.max() > 1 - EPSILON else float(-np.expm1(np.log1p(-p).sum()))
            if ep < min_probability - EPSILON:
                return
            eu = float((u * p).sum())
            if eu >= floor - EPSILON:
                out.append((sorted(items), eu, ep, len(items)))
                if len(out) >= 4 * k + 100:
                    best = np.sort([x[1] for x in out])[::-1]
                    floor = max(floor, float(best[k - 1]) - TIE)
                    out = [x for x in out if x[1] >= floor]
            if float((np.maximum(u + rem, 0) * p).sum()) < floor - EPSILON or (max_depth and len(items) >= max_depth):
                return
            where = np.full(len(tids), -1)
            where[tid] = np.arange(len(tid))
            for r in range(at + 1, len(lists)):
                item, t2, u2, rem2, l2 = lists[r]
                both = where[t2] >= 0
                if both.any():
                    mine = where[t2[both]]
                    visit([*items, item], r, t2[both], u[mine] + u2[both], rem2[both], logp[mine] + l2[both])

        first = np.unique(index, return_index=True)[1]
        pu, pl = (pdf[c].to_numpy()[first] for c in ("pu", "pl"))
        if not max_depth or len(prefix) < max_depth:
            for r, (item, t, u, rem, logp) in enumerate(lists):
                visit([*prefix, item], r, t, pu[t] + u, rem, pl[t] + logp)
        return pd.DataFrame(out, columns=["items", "eu", "ep", "size"])

    return run


def prefix(rows: DataFrame, cfg: MiningConfig) -> DataFrame:
    """One task per prefix item searches depth-first below it; for long, dense transactions.

    Items whose bound does not suffice are no prefix. A prefix with more than ``GROUP_ROWS`` rows is split by its second
    item; where that is not enough, the levelwise search gives the answer instead. Rows are counted only where the most
    frequent item and the longest transaction leave room for so many. ``rows`` are read several times: the caller caches
    them.
    """
    singles, seen = _persisted(_singles(rows)), Observation()
    best = top_k(_results(singles.observe(seen, (F.max("support") * F.max("place")).alias("most")), 0.0, cfg), cfg.k).collect()
    least = least_of(best, cfg.k)
    later = rows.join(_later(singles, least, cfg), "item", "left_semi")
    head = later.join(_open(singles, least, cfg).select("item"), "item", "left_semi").select(F.col("tid").alias("t"), F.col("item").alias("head"), F.col("rank").alias("hr"), F.col("u").alias("pu"), F.col("logp").alias("pl"))
    below = head.join(later, (F.col("t") == F.col("tid")) & (F.col("rank") > F.col("hr")))
    heavy = kept(below.groupBy("head").count().filter(F.col("count") > GROUP_ROWS).select("head")) if (seen.get["most"] or 0) > GROUP_ROWS else None
    shape = ("head", "second", "tid", "item", "ptwu", "u", "rem", "logp", "pu", "pl")
    groups = below.withColumn("second", F.lit(None).cast("int"))
    found = rows.sparkSession.createDataFrame(best, FOUND)
    if heavy is not None and not heavy.isEmpty():
        split = below.join(heavy, "head", "left_semi")
        pair = split.select("head", F.col("item").alias("second"), "t", F.col("rank").alias("r2"), (F.col("pu") + F.col("u")).alias("pu"), (F.col("pl") + F.col("logp")).alias("pl"), "rem")
        if not cfg.max_depth or cfg.max_depth > 1:
            two = measures(pair.withColumnsRenamed({"pu": "u", "pl": "logp"}), "head", "second").withColumn("items", F.array_sort(F.array("head", "second")))
            found = found.unionByName(_results(two, least, cfg))
        deeper = pair.drop("rem").join(later, (F.col("t") == F.col("tid")) & (F.col("rank") > F.col("r2")))
        if not deeper.groupBy("head", "second").count().filter(F.col("count") > GROUP_ROWS).isEmpty():
            singles.unpersist()
            return levelwise(rows, cfg)
        groups = groups.join(heavy, "head", "left_anti").select(*shape).unionByName(deeper.select(*shape))
    searched = groups.select(*shape).groupBy("head", "second").applyInPandas(_search(cfg.k, cfg.min_probability, cfg.max_depth, least), FOUND)
    found = top_k(found.unionByName(searched), cfg.k).collect()
    singles.unpersist()
    return rows.sparkSession.createDataFrame(found, FOUND)


def _rows(transactions: DataFrame, profits: DataFrame) -> DataFrame:
    return ranked_rows(usable(transactions, profits), profits.count() <= SMALL_TABLE)


def _search_by(rows: DataFrame, cfg: MiningConfig, order: str = "utility", statistics: Statistics | None = None) -> DataFrame:
    found = levelwise(rows, cfg, statistics) if cfg.strategy == "levelwise" else {"powerset": powerset, "prefix": prefix}[cfg.strategy](rows, cfg)
    return ranked(top_k(found, cfg.k), cfg.k, order)


def mine(transactions: DataFrame, profits: DataFrame, cfg: MiningConfig | None = None, order: str = "utility", statistics: Statistics | None = None) -> DataFrame:
    """rank, items (sorted), eu, ep, size of the top-K itemsets of (tid, item, qty, prob) and (item, profit).

    ``statistics`` are filled by the levelwise strategy, at the cost of an action a level.
    """
    cfg = cfg or MiningConfig()
    rows = _rows(transactions, profits)
    found = _search_by(rows if cfg.strategy == "powerset" else _persisted(rows), cfg, order, statistics)
    rows.unpersist()
    return found


def sweep(transactions: DataFrame, profits: DataFrame, ks: list[int], probabilities: list[float], base: MiningConfig | None = None) -> DataFrame:
    """Results for every pair of k and least probability, from one search for the largest k at each probability.

    The utility rows are made once for all searches.
    """
    base, out = base or MiningConfig(), None
    rows = _persisted(_rows(transactions, profits))
    for p in probabilities or [base.min_probability]:
        whole = _search_by(rows, MiningConfig(max(ks or [base.k]), p, base.strategy, base.max_depth, base.ep_prune, base.policy))
        for k in ks or [base.k]:
            part = whole.filter(F.col("rank") <= k).select(F.lit(k).alias("k"), F.lit(p).alias("min_probability"), "*")
            out = part if out is None else out.unionByName(part)
    rows.unpersist()
    return out
