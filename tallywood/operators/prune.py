"""Pruning tests as filters over tables of measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON


def prune_ptwu(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("ptwu") >= threshold - EPSILON)


def prune_ep(df: DataFrame, min_probability: float) -> DataFrame:
    return df.filter(F.col("ep") >= min_probability - EPSILON)


def prune_bound(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("bound") >= threshold - EPSILON)


def prune_prob_sum(df: DataFrame, min_probability: float) -> DataFrame:
    return df.filter(F.col("prob_sum") >= min_probability - EPSILON)


def prune_rtwu(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("rtwu") >= threshold - EPSILON)


def prune_pairs(level: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Itemsets all of whose pairs have a pair bound that reaches the threshold; single items stay."""
    good = pairs.filter(F.col("bound") >= threshold - EPSILON).select("i1", "i2")
    sets = level.select("items").distinct()
    each = sets.select("items", F.explode("items").alias("i1")).select("items", "i1", F.explode("items").alias("i2")).filter("i1 < i2")
    return level.join(each.join(good, ["i1", "i2"], "left_anti").select("items").distinct(), "items", "left_anti")


def prune_extensions(candidates: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Candidates (items, item) whose new item reaches the threshold with every item of the set."""
    good = pairs.filter(F.col("bound") >= threshold - EPSILON).select(F.col("i1").alias("lo_"), F.col("i2").alias("hi_"))
    each = candidates.select("items", "item").distinct().select("items", "item", F.explode("items").alias("x_"))
    bad = each.join(good, (F.least("x_", "item") == F.col("lo_")) & (F.greatest("x_", "item") == F.col("hi_")), "left_anti").select("items", "item").distinct()
    return candidates.join(bad, ["items", "item"], "left_anti")


def prune_combined(level: DataFrame, pairs: DataFrame, threshold: float, min_probability: float) -> DataFrame:
    """Probability, bound and pair bounds, the cheap tests first."""
    return prune_pairs(prune_bound(prune_ep(level, min_probability), threshold), pairs, threshold)


def prune_score(df: DataFrame, threshold: float, min_probability: float, alpha: float = 0.5) -> DataFrame:
    """A heuristic: weighted share of the threshold (1 at most) and probability reach those of the limits."""
    score = alpha * F.least(F.lit(1.0), F.col("eu") / F.greatest(F.lit(float(threshold)), F.lit(1.0))) + (1 - alpha) * F.col("ep")
    return df.filter(score >= alpha + (1 - alpha) * min_probability)


def prune_size(df: DataFrame, most_items: int, least_density: float) -> DataFrame:
    """A heuristic: at most so many items, at least so much utility an item."""
    return df.filter((F.size("items") <= most_items) & (F.col("eu") / F.size("items") >= least_density))


def filter_entries(tx: DataFrame, min_probability: float = 0.0, items: list[int] | None = None) -> DataFrame:
    """Transactions' entries of a least probability, and of some items only."""
    out = tx.filter(F.col("prob") >= min_probability)
    return out if items is None else out.filter(F.col("item").isin(items))


def filter_list(rows: DataFrame, min_probability: float) -> DataFrame:
    """Rows of utility lists of a least probability."""
    return rows.filter(F.exp("logp") >= min_probability - EPSILON)


def qualify(df: DataFrame, threshold: float, min_probability: float) -> DataFrame:
    return df.filter((F.col("eu") >= threshold - EPSILON) & (F.col("ep") >= min_probability - EPSILON))
