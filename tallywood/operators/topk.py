"""Result orders, top-K and its threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TIE
from ..functions import combined_score, density

#: Sums are rounded where they decide an order, so that equal values tie whatever order they were added in.
_EU, _EP = (lambda: F.round("eu", 6)), (lambda: F.round("ep", 6))
ORDERS = {
    "utility": lambda: [_EU().desc(), _EP().desc(), F.col("size"), F.col("items")],
    "score": lambda: [F.round(combined_score(), 6).desc(), F.col("size"), F.col("items")],
    "density": lambda: [F.round(density(), 6).desc(), F.col("size"), F.col("items")],
    "size": lambda: [F.col("size"), _EU().desc(), F.col("items")],
    "size_desc": lambda: [F.col("size").desc(), _EU().desc(), F.col("items")],
}


def top_k(df: DataFrame, k: int, order: str = "utility") -> DataFrame:
    """The k first rows (items, eu, ep, size) of an order: sorted heads of the partitions, then of those."""
    return df.orderBy(*ORDERS[order]()).limit(k)


def ranked(df: DataFrame, k: int, order: str = "utility") -> DataFrame:
    """rank, items, eu, ep, size of the top k."""
    return top_k(df, k, order).select(F.row_number().over(Window.orderBy(*ORDERS[order]())).alias("rank"), "items", "eu", "ep", "size")


def least_of(found: list, k: int) -> float:
    """What an itemset's expected utility must reach to displace one of ``found``: below the k-th best by what may tie."""
    return max(0.0, min(r["eu"] for r in found) - TIE) if len(found) >= k else 0.0


def threshold(df: DataFrame, k: int) -> float:
    """``least_of`` the k best rows; 0 if there are fewer."""
    return least_of(df.orderBy(F.desc("eu")).limit(k).collect(), k)


def would_accept(result: DataFrame, k: int, eu: float) -> bool:
    """Whether an itemset of this expected utility could enter a result."""
    return eu >= threshold(result, k)


def contains(result: DataFrame, items: list[int]) -> bool:
    return not result.filter(F.col("items") == F.array(*[F.lit(i) for i in sorted(items)])).isEmpty()


def statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min("eu").alias("min_eu"), F.max("eu").alias("max_eu"), F.avg("eu").alias("avg_eu"), F.avg("ep").alias("avg_ep"))


def profit_statistics(profits: DataFrame) -> DataFrame:
    p = F.col("profit")
    return profits.agg(F.count("*").alias("n"), F.count_if(p > 0).alias("positive"), F.count_if(p < 0).alias("negative"), F.avg(p).alias("avg_profit"), F.min(p).alias("min_profit"), F.max(p).alias("max_profit"))


def violations(result: DataFrame, k: int, min_probability: float) -> DataFrame:
    """One row: how many rows break an invariant of results (order, least EP, count, no empty set)."""
    w = Window.orderBy("rank")
    flagged = result.withColumn("rises", F.round("eu", 6) > F.lag(F.round("eu", 6)).over(w))
    return flagged.agg(F.count_if("rises").alias("rises"), F.count_if(F.col("ep") < min_probability - 1e-9).alias("low_ep"), F.count_if(F.size("items") == 0).alias("empty"), F.greatest(F.count("*") - k, F.lit(0)).alias("too_many"))
