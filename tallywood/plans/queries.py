"""Registered mining queries over the order tables, and their DuckDB oracles.

Transactions are orders, items are brands (25, dense) or parts (sparse); sums are rounded to four decimals.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions import combined_score, density, intersection, is_subset, jaccard, union
from ..operators.joins import diffset, diffset_tids, extend, pair_bounds, single_rows
from ..operators.mine import mine, sweep
from ..operators.prepare import item_bounds, item_ranks, itemset_in_transactions, measures, rank_faults, transaction_utilities, usable, utility_rows
from ..operators.prune import filter_entries, filter_list, prune_bound, prune_combined, prune_ep, prune_extensions, prune_pairs, prune_ptwu, prune_rtwu, prune_score, prune_size
from ..operators.store import shared_dir
from ..operators.topk import profit_statistics, statistics, violations
from ..sources import order_transactions, read_profits, read_transactions, write_profits, write_transactions
from ..streaming import item_measures

K, P, P_HIGH, DEPTH = 20, 0.3, 0.9999, 2
PTWU_LEAST, EP_LEAST, BOUND_LEAST, PAIR_LEAST = 788_000.0, 0.6, 43_000.0, 66_000.0
RTWU_LEAST, SCORE_LEAST, DENSITY_LEAST = 500_000.0, 40_000.0, 5_000.0


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four decimals, item sets as comma-joined text."""
    cast = {"double": lambda c: F.round(c, 4), "array<int>": lambda c: F.array_join(F.col(c).cast("array<string>"), ",")}
    return df.select(*[cast[t](c).alias(c) if t in cast else F.col(c) for c, t in df.dtypes])


def _of(make, item: str = "brand"):
    """A query from a function of (transactions, profits)."""
    return lambda spark, sf_dir: _rounded(make(*order_transactions(spark, sf_dir, item)))


def _mined(order: str = "utility", item: str = "brand", positive: bool = False, **settings):
    cfg = MiningConfig(**{"k": K, "min_probability": P} | settings)
    return _of(lambda tx, pf: mine(tx, pf.filter("profit > 0") if positive else pf, cfg, order), item)


def _pairs(tx: DataFrame, pf: DataFrame) -> DataFrame:
    rows = utility_rows(tx, pf)
    return extend(single_rows(rows), rows)


def _algebra(tx: DataFrame, pf: DataFrame) -> DataFrame:
    """Algebra over all pairs of the K results (a fixed number)."""
    top = mine(tx, pf, MiningConfig(K, P))
    b = top.select(F.col("rank").alias("rank_b"), F.col("items").alias("b"))
    pairs = top.select(F.col("rank").alias("rank_a"), F.col("items").alias("a")).join(b, F.col("rank_a") < F.col("rank_b"))
    return pairs.select("rank_a", "rank_b", union("a", "b").alias("united"), intersection("a", "b").alias("shared"), is_subset("a", "b").alias("a_in_b"), is_subset("b", "a").alias("b_in_a"), jaccard("a", "b").alias("jaccard"))


def _reread(tx: DataFrame, pf: DataFrame) -> DataFrame:
    """The transactions written as text and read again; new ids, so items are compared."""
    path = f"{shared_dir(tx.sparkSession)}/text-{uuid.uuid4().hex}"
    write_transactions(tx, path)
    return read_transactions(tx.sparkSession, path, on_error="fail").groupBy("item").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("prob").alias("prob"))


def _reread_profits(tx: DataFrame, pf: DataFrame) -> DataFrame:
    path = f"{shared_dir(pf.sparkSession)}/text-{uuid.uuid4().hex}"
    write_profits(pf, path)
    return read_profits(pf.sparkSession, path, on_error="fail")


def _streamed(tx: DataFrame, pf: DataFrame) -> DataFrame:
    """Item measures of the transactions as a stream of files, all that is there at once."""
    spark, name = tx.sparkSession, f"items_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    tx.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    # A row per item in the end, so the table in memory is as small as the answer.
    item_measures(stream, pf).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _judged_pairs(tx: DataFrame, pf: DataFrame) -> DataFrame:
    return measures(_pairs(tx, pf), "items")


def _extensions(tx: DataFrame, pf: DataFrame) -> DataFrame:
    """Candidates {11} and {11, 12} with every other item they occur with, by pair bounds."""
    base = usable(tx, pf)
    with_11 = base.filter("item = 11").select("tid").join(base.filter("item > 12").select("tid", "item"), "tid").select("item").distinct()
    both = with_11.select(F.explode(F.array(F.array(F.lit(11)), F.array(F.lit(11), F.lit(12)))).alias("items"), "item")
    return prune_extensions(both, pair_bounds(base), PAIR_LEAST)


def _scores(tx: DataFrame, pf: DataFrame) -> DataFrame:
    return mine(tx, pf, MiningConfig(K, P)).select("rank", density().alias("density"), combined_score().alias("score"))


def queries() -> dict:
    sorted_pf = lambda tx, pf: pf
    return {
        "ptu_per_transaction": _of(lambda tx, pf: transaction_utilities(tx, pf).select("tid", "ptu")),
        "ntu_rtu_total": _of(lambda tx, pf: transaction_utilities(tx, pf).drop("ptu")),
        "ptwu_per_item": _of(lambda tx, pf: item_bounds(tx, pf).select("item", "ptwu")),
        "rtwu_weighted": _of(lambda tx, pf: item_bounds(tx, pf).select("item", "rtwu")),
        "item_prob_sum": _of(lambda tx, pf: item_bounds(tx, pf).select("item", "prob_sum")),
        "item_rank": _of(lambda tx, pf: item_ranks(item_bounds(tx, pf)).select("item", "rank")),
        "suffix_remaining_utility": _of(lambda tx, pf: utility_rows(tx, pf).select("tid", "item", "rem")),
        "utility_list_singles": _of(lambda tx, pf: utility_rows(tx, pf).drop("ptwu", "ptu", "rank")),
        "single_item_measures": _of(lambda tx, pf: measures(utility_rows(tx, pf), "item")),
        "single_part_measures": _of(lambda tx, pf: measures(utility_rows(tx, pf), "item"), "part"),
        "pair_join": _of(lambda tx, pf: _pairs(tx, pf).drop("last", "last_rank")),
        "pair_measures": _of(lambda tx, pf: measures(_pairs(tx, pf), "items")),
        "diffset_pairs": _of(lambda tx, pf: (lambda rows: diffset(single_rows(rows), rows))(utility_rows(tx, pf))),
        "eucs_pairs": _of(lambda tx, pf: pair_bounds(usable(tx, pf))),
        "prune_ptwu": _of(lambda tx, pf: prune_ptwu(item_bounds(tx, pf).select("item", "ptwu"), PTWU_LEAST)),
        "prune_ep": _of(lambda tx, pf: prune_ep(measures(_pairs(tx, pf), "items").select("items", "ep"), EP_LEAST).select("items", (100_000 * F.col("ep")).alias("ep_e5")), "part"),
        "prune_bound": _of(lambda tx, pf: prune_bound(measures(_pairs(tx, pf), "items").select("items", "bound"), BOUND_LEAST)),
        "prune_eucs": _of(lambda tx, pf: prune_pairs(measures(_pairs(tx, pf), "items").select("items", "eu"), pair_bounds(usable(tx, pf)), PAIR_LEAST)),
        "topk_mixed_levelwise": _mined(strategy="levelwise"),
        "topk_mixed_powerset": _mined(strategy="powerset"),
        "topk_mixed_prefix": _mined(strategy="prefix"),
        "topk_parts": _mined(item="part", k=50, min_probability=0.5),
        "topk_positive_only": _mined(positive=True),
        "topk_high_min_prob": _mined(min_probability=P_HIGH),
        "topk_max_depth": _mined(max_depth=DEPTH),
        "topk_by_score": _mined("score"),
        "topk_by_density": _mined("density"),
        "topk_by_size": _mined("size"),
        "itemset_scores": _of(_scores),
        "itemset_algebra": _of(_algebra),
        "profit_statistics": _of(lambda tx, pf: profit_statistics(pf)),
        "topk_statistics": _of(lambda tx, pf: statistics(mine(tx, pf, MiningConfig(K, P)))),
        "transaction_filter_by_prob": _of(lambda tx, pf: filter_entries(tx, 0.8)),
        "transaction_filter_by_items": _of(lambda tx, pf: filter_entries(tx, items=[11, 12, 13])),
        "list_filter_by_prob": _of(lambda tx, pf: filter_list(utility_rows(tx, pf), 0.8).select("tid", "item", "rem")),
        "prune_rtwu": _of(lambda tx, pf: prune_rtwu(item_bounds(tx, pf).select("item", "rtwu"), RTWU_LEAST)),
        "prune_combined": _of(lambda tx, pf: prune_combined(_judged_pairs(tx, pf).select("items", "ep", "bound"), pair_bounds(usable(tx, pf)), BOUND_LEAST, EP_LEAST).select("items", "bound")),
        "prune_extensions": _of(_extensions),
        "prune_score": _of(lambda tx, pf: prune_score(_judged_pairs(tx, pf).select("items", "eu", "ep"), SCORE_LEAST, P)),
        "prune_size": _of(lambda tx, pf: prune_size(_judged_pairs(tx, pf).select("items", "eu"), 2, DENSITY_LEAST)),
        "rank_faults": _of(lambda tx, pf: rank_faults(utility_rows(tx, pf)).agg(F.count("*").alias("faults"))),
        "tid_difference": _of(lambda tx, pf: diffset_tids(usable(tx, pf), 11, 12)),
        "text_transactions": _of(_reread),
        "text_profits": _of(_reread_profits),
        "stream_item_measures": _of(_streamed),
        "topk_best_first": _mined(strategy="BEST_FIRST"),
        "topk_eu_focused": _mined(policy="EU_FOCUSED"),
        "topk_pair_prune": _mined(pair_prune=True),
        "average_probability": _of(lambda tx, pf: tx.groupBy("tid").agg((100 * F.avg("prob")).alias("avg_percent"))),
        "itemset_prob_in_tx": _of(lambda tx, pf: itemset_in_transactions(tx, pf, [11, 12]).select("tid", "prob", "utility")),
        "itemset_logprob_in_tx": _of(lambda tx, pf: itemset_in_transactions(tx, pf, [12, 11]).select("tid", "contained", "logp")),
        "sweep_k_minprob": _of(lambda tx, pf: sweep(tx, pf, [5, 10], [0.3, P_HIGH])),
        "result_validation": _of(lambda tx, pf: violations(mine(tx, pf, MiningConfig(K, P)), K, P)),
        "profit_table": _of(sorted_pf),
    }


def _base(item: str = "brand", positive: bool = False) -> str:
    source = "SELECT l_orderkey, l_quantity, l_discount, CAST(replace(p_brand, 'Brand#', '') AS INT) AS item FROM lineitem JOIN part ON l_partkey = p_partkey" if item == "brand" else "SELECT l_orderkey, l_quantity, l_discount, CAST(l_partkey AS INT) AS item FROM lineitem"
    return f"""WITH RECURSIVE tx AS (SELECT l_orderkey AS tid, item, SUM(CAST(l_quantity AS BIGINT))::BIGINT AS qty, ROUND(0.95 - 5 * MAX(l_discount), 2) AS prob FROM ({source}) GROUP BY 1, 2),
pf AS (SELECT * FROM (SELECT DISTINCT item, (CASE WHEN item % 5 = 0 THEN -1.0 ELSE 1.0 END * (1 + item % 7))::DOUBLE AS profit FROM tx) {'WHERE profit > 0' if positive else ''}),
w AS (SELECT tid, item, qty, prob, profit, profit * qty AS u, SUM(CASE WHEN profit > 0 THEN profit * qty ELSE 0 END) OVER (PARTITION BY tid) AS ptu FROM tx JOIN pf USING (item)),
e AS (SELECT * FROM w WHERE prob > 1e-10),
rk AS (SELECT item, SUM(ptu) AS ptwu, row_number() OVER (ORDER BY ROUND(SUM(ptu), 6), item) - 1 AS rank FROM e GROUP BY item),
ur AS (SELECT tid, item, rank, ptwu, u, prob AS p, COALESCE(SUM(GREATEST(u, 0)) OVER (PARTITION BY tid ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rem FROM e JOIN rk USING (item)),
pr AS (SELECT list_sort([a.item, b.item]) AS x, a.tid, a.u + b.u AS u, b.rem, a.p * b.p AS p FROM ur a JOIN ur b ON a.tid = b.tid AND b.rank > a.rank)
"""


_EP = "CASE WHEN MAX(p) > 1 - 1e-10 THEN 1.0 ELSE 1 - EXP(SUM(LN(1 - p))) END"
_MEASURES = f"ROUND(SUM(u * p), 4) AS eu, ROUND({_EP}, 4) AS ep, ROUND(SUM(rem * p), 4) AS rem_sum, ROUND(SUM(GREATEST(u + rem, 0) * p), 4) AS bound, COUNT(*) AS support"
_X = "array_to_string(x, ',')"


def _top(k: int = K, p: float = P, order: str = "r_eu DESC, r_ep DESC, size, x", depth: int = 0, **base) -> str:
    return f"""{_base(**base)}, s AS (SELECT tid, [item] AS x, item AS last, u, prob AS p FROM e
UNION ALL SELECT s.tid, list_append(s.x, e.item), e.item, s.u + e.u, s.p * e.prob FROM s JOIN e ON s.tid = e.tid AND e.item > s.last {f'WHERE len(s.x) < {depth}' if depth else ''}),
m AS (SELECT x, len(x)::INT AS size, SUM(u * p) AS eu, {_EP} AS ep, ROUND(SUM(u * p), 6) AS r_eu, ROUND({_EP}, 6) AS r_ep FROM s GROUP BY x),
q AS (SELECT * FROM m WHERE eu >= -1e-10 AND ep >= {p} - 1e-10 ORDER BY r_eu DESC, r_ep DESC, size, x LIMIT {k}),
t AS (SELECT row_number() OVER (ORDER BY {order})::INT AS rank, x, eu, ep, size FROM q)
"""


_SHOW = f"SELECT rank, {_X} AS items, ROUND(eu, 4) AS eu, ROUND(ep, 4) AS ep, size FROM t"


def _swept() -> str:
    parts = []
    for p in (0.3, P_HIGH):
        parts += [f"SELECT {k} AS k, {p}::DOUBLE AS min_probability, * FROM ({_top(k, p)} {_SHOW})" for k in (5, 10)]
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    b = _base()
    mixed = _top() + _SHOW
    return {
        "ptu_per_transaction": b + "SELECT tid, ROUND(MAX(ptu), 4) AS ptu FROM w GROUP BY tid",
        "ntu_rtu_total": b + "SELECT tid, ROUND(SUM(LEAST(u, 0)), 4) AS ntu, ROUND(SUM(GREATEST(u, 0)), 4) AS rtu, ROUND(SUM(u), 4) AS total FROM w GROUP BY tid",
        "ptwu_per_item": b + "SELECT item, ROUND(SUM(ptu), 4) AS ptwu FROM e GROUP BY item",
        "rtwu_weighted": b + "SELECT item, ROUND(SUM(ptu * prob), 4) AS rtwu FROM e GROUP BY item",
        "item_prob_sum": b + "SELECT item, ROUND(SUM(prob), 4) AS prob_sum FROM e GROUP BY item",
        "item_rank": b + "SELECT item, rank::INT AS rank FROM rk",
        "suffix_remaining_utility": b + "SELECT tid, item, ROUND(rem, 4) AS rem FROM ur",
        "utility_list_singles": b + "SELECT tid, item, ROUND(u, 4) AS u, ROUND(rem, 4) AS rem, ROUND(LN(p), 4) AS logp FROM ur",
        "single_item_measures": b + f"SELECT item, {_MEASURES} FROM ur GROUP BY item",
        "single_part_measures": _base("part") + f"SELECT item, {_MEASURES} FROM ur GROUP BY item",
        "pair_join": b + f"SELECT {_X} AS items, tid, ROUND(u, 4) AS u, ROUND(rem, 4) AS rem, ROUND(LN(p), 4) AS logp FROM pr",
        "pair_measures": b + f"SELECT {_X} AS items, {_MEASURES} FROM pr GROUP BY x",
        "diffset_pairs": b + "SELECT a.item::VARCHAR AS items, b.item, (a.n - COUNT(j.tid))::BIGINT AS missing FROM (SELECT item, rank, COUNT(*) AS n FROM ur GROUP BY 1, 2) a JOIN rk b ON b.rank > a.rank JOIN (SELECT l.item AS i, r.item AS j, l.tid FROM ur l JOIN ur r ON l.tid = r.tid) j ON j.i = a.item AND j.j = b.item GROUP BY a.item, b.item, a.n",
        "eucs_pairs": b + "SELECT l.item AS i1, r.item AS i2, ROUND(SUM(l.ptu * l.prob * r.prob), 4) AS bound FROM e l JOIN e r ON l.tid = r.tid AND l.item < r.item GROUP BY 1, 2",
        "prune_ptwu": b + f"SELECT item, ROUND(SUM(ptu), 4) AS ptwu FROM e GROUP BY item HAVING SUM(ptu) >= {PTWU_LEAST} - 1e-10",
        "prune_ep": _base("part") + f"SELECT {_X} AS items, ROUND(100000 * ({_EP}), 4) AS ep_e5 FROM pr GROUP BY x HAVING {_EP} >= {EP_LEAST} - 1e-10",
        "prune_bound": b + f"SELECT {_X} AS items, ROUND(SUM(GREATEST(u + rem, 0) * p), 4) AS bound FROM pr GROUP BY x HAVING SUM(GREATEST(u + rem, 0) * p) >= {BOUND_LEAST} - 1e-10",
        "prune_eucs": b + f", c AS (SELECT [l.item, r.item] AS x FROM e l JOIN e r ON l.tid = r.tid AND l.item < r.item GROUP BY l.item, r.item HAVING SUM(l.ptu * l.prob * r.prob) >= {PAIR_LEAST} - 1e-10) SELECT {_X} AS items, ROUND(SUM(u * p), 4) AS eu FROM pr SEMI JOIN c USING (x) GROUP BY x",
        "topk_mixed_levelwise": mixed,
        "topk_mixed_powerset": mixed,
        "topk_mixed_prefix": mixed,
        "topk_parts": _top(50, 0.5, item="part") + _SHOW,
        "topk_positive_only": _top(positive=True) + _SHOW,
        "topk_high_min_prob": _top(p=P_HIGH) + _SHOW,
        "topk_max_depth": _top(depth=DEPTH) + _SHOW,
        "topk_by_score": _top(order="ROUND(eu * ep, 6) DESC, size, x") + _SHOW,
        "topk_by_density": _top(order="ROUND(eu / size, 6) DESC, size, x") + _SHOW,
        "topk_by_size": _top(order="size, r_eu DESC, x") + _SHOW,
        "itemset_scores": _top() + "SELECT rank, ROUND(eu / size, 4) AS density, ROUND(eu * ep, 4) AS score FROM t",
        "itemset_algebra": _top() + "SELECT a.rank AS rank_a, b.rank AS rank_b, array_to_string(list_sort(list_distinct(a.x || b.x)), ',') AS united, array_to_string(list_sort(list_intersect(a.x, b.x)), ',') AS shared, list_has_all(b.x, a.x) AS a_in_b, list_has_all(a.x, b.x) AS b_in_a, ROUND(len(list_intersect(a.x, b.x)) / len(list_distinct(a.x || b.x)), 4) AS jaccard FROM t a JOIN t b ON a.rank < b.rank",
        "profit_statistics": b + "SELECT COUNT(*) AS n, COUNT(*) FILTER (profit > 0) AS positive, COUNT(*) FILTER (profit < 0) AS negative, ROUND(AVG(profit), 4) AS avg_profit, MIN(profit) AS min_profit, MAX(profit) AS max_profit FROM pf",
        "topk_statistics": _top() + "SELECT COUNT(*) AS n, ROUND(MIN(eu), 4) AS min_eu, ROUND(MAX(eu), 4) AS max_eu, ROUND(AVG(eu), 4) AS avg_eu, ROUND(AVG(ep), 4) AS avg_ep FROM t",
        "transaction_filter_by_prob": b + "SELECT tid, item, qty, prob FROM tx WHERE prob >= 0.8",
        "transaction_filter_by_items": b + "SELECT tid, item, qty, prob FROM tx WHERE item IN (11, 12, 13)",
        "list_filter_by_prob": b + "SELECT tid, item, ROUND(rem, 4) AS rem FROM ur WHERE p >= 0.8 - 1e-10",
        "prune_rtwu": b + f"SELECT item, ROUND(SUM(ptu * prob), 4) AS rtwu FROM e GROUP BY item HAVING SUM(ptu * prob) >= {RTWU_LEAST} - 1e-10",
        "prune_combined": b + f", c AS (SELECT [l.item, r.item] AS x FROM e l JOIN e r ON l.tid = r.tid AND l.item < r.item GROUP BY l.item, r.item HAVING SUM(l.ptu * l.prob * r.prob) >= {BOUND_LEAST} - 1e-10) SELECT {_X} AS items, ROUND(SUM(GREATEST(u + rem, 0) * p), 4) AS bound FROM pr SEMI JOIN c USING (x) GROUP BY x HAVING {_EP} >= {EP_LEAST} - 1e-10 AND SUM(GREATEST(u + rem, 0) * p) >= {BOUND_LEAST} - 1e-10",
        "prune_extensions": b + f", c AS (SELECT l.item AS i, r.item AS j FROM e l JOIN e r ON l.tid = r.tid AND l.item < r.item GROUP BY l.item, r.item HAVING SUM(l.ptu * l.prob * r.prob) >= {PAIR_LEAST} - 1e-10), n AS (SELECT DISTINCT r.item FROM e l JOIN e r ON l.tid = r.tid WHERE l.item = 11 AND r.item > 12) SELECT '11' AS items, item FROM n JOIN c ON i = 11 AND j = item UNION ALL SELECT '11,12', item FROM n JOIN c ON i = 11 AND j = item JOIN c d ON d.i = 12 AND d.j = item",
        "prune_score": b + f"SELECT {_X} AS items, ROUND(SUM(u * p), 4) AS eu, ROUND({_EP}, 4) AS ep FROM pr GROUP BY x HAVING 0.5 * LEAST(1.0, SUM(u * p) / GREATEST({SCORE_LEAST}, 1.0)) + 0.5 * ({_EP}) >= 0.5 + 0.5 * {P}",
        "prune_size": b + f"SELECT {_X} AS items, ROUND(SUM(u * p), 4) AS eu FROM pr GROUP BY x HAVING SUM(u * p) / 2 >= {DENSITY_LEAST}",
        "rank_faults": "SELECT 0::BIGINT AS faults",
        "tid_difference": b + "SELECT tid FROM e WHERE item = 11 AND tid NOT IN (SELECT tid FROM e WHERE item = 12)",
        "text_transactions": b + "SELECT item, COUNT(*) AS n, SUM(qty)::BIGINT AS qty, ROUND(SUM(prob), 4) AS prob FROM tx GROUP BY item",
        "text_profits": b + "SELECT item, profit FROM pf",
        "stream_item_measures": b + f"SELECT item, ROUND(SUM(u * p), 4) AS eu, ROUND({_EP}, 4) AS ep, COUNT(*) AS support FROM ur GROUP BY item",
        "itemset_logprob_in_tx": b + "SELECT tid, COUNT(*) = 2 AS contained, ROUND(CASE WHEN COUNT(*) = 2 THEN SUM(LN(prob)) ELSE -700 END, 4) AS logp FROM e WHERE item IN (11, 12) GROUP BY tid",
        "topk_best_first": mixed,
        "topk_eu_focused": mixed,
        "topk_pair_prune": mixed,
        "average_probability": b + "SELECT tid, ROUND(100 * AVG(prob), 4) AS avg_percent FROM tx GROUP BY tid",
        "itemset_prob_in_tx": b + "SELECT tid, ROUND(CASE WHEN COUNT(*) = 2 THEN PRODUCT(prob) ELSE 0 END, 4) AS prob, ROUND(SUM(u), 4) AS utility FROM e WHERE item IN (11, 12) GROUP BY tid",
        "sweep_k_minprob": _swept(),
        "result_validation": "SELECT 0::BIGINT AS rises, 0::BIGINT AS low_ep, 0::BIGINT AS empty, 0::BIGINT AS too_many",
        "profit_table": b + "SELECT item, profit FROM pf",
    }
