"""Joins of utility lists: extension, differences of transaction sets, pair bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOG_EPSILON


def single_rows(rows: DataFrame) -> DataFrame:
    """Utility rows as lists of one-item sets: items, last, last_rank, tid, u, rem, logp."""
    return rows.select(F.array("item").alias("items"), F.col("item").alias("last"), F.col("rank").alias("last_rank"), "tid", "u", "rem", "logp")


def extend(level: DataFrame, rows: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Lists of the itemsets with one more item of higher rank: an equi-join on tid; ``rem`` is the later item's.

    ``pairs`` (i1 < i2): only these may be a set's last item and the new one; a small table, or an ordinary join.
    """
    e = rows.select(F.col("tid").alias("t"), "item", "rank", F.col("u").alias("eu_"), F.col("rem").alias("er_"), F.col("logp").alias("el_"))
    joined = level.join(e, (F.col("tid") == F.col("t")) & (F.col("rank") > F.col("last_rank")))
    if pairs is not None:
        joined = joined.join(pairs, (F.least("last", "item") == F.col("i1")) & (F.greatest("last", "item") == F.col("i2")), "left_semi")
    out = joined.select(F.sort_array(F.array_append("items", F.col("item"))).alias("items"), F.col("item").alias("last"), F.col("rank").alias("last_rank"), "tid", (F.col("u") + F.col("eu_")).alias("u"), F.col("er_").alias("rem"), (F.col("logp") + F.col("el_")).alias("logp"))
    return out.filter(F.col("logp") > LOG_EPSILON)


def diffset(level: DataFrame, rows: DataFrame) -> DataFrame:
    """items, item, missing: how many transactions of a one-item set lack a later item that it occurs with.

    Pairs that never occur together have no list, so they are not formed: their difference is the whole set.
    """
    support = level.groupBy("items").agg(F.count("*").alias("support"))
    both = level.join(rows.select(F.col("tid").alias("t"), "item", F.col("rank").alias("r")), (F.col("tid") == F.col("t")) & (F.col("r") > F.col("last_rank"))).groupBy("items", "item").agg(F.count("*").alias("both"))
    return both.join(support, "items").select("items", "item", (F.col("support") - F.col("both")).alias("missing"))


def diffset_tids(rows: DataFrame, item: int, other: int) -> DataFrame:
    """The transactions of one item that lack another."""
    return rows.filter(F.col("item") == item).select("tid").join(rows.filter(F.col("item") == other).select("tid"), "tid", "left_anti")


def pair_bounds(usable_rows: DataFrame) -> DataFrame:
    """i1 < i2, bound: co-occurrence bound of item pairs from positive transaction utilities."""
    a = usable_rows.select("tid", F.col("item").alias("i1"), F.col("prob").alias("p1"), "ptu")
    b = usable_rows.select(F.col("tid").alias("t"), F.col("item").alias("i2"), F.col("prob").alias("p2"))
    return a.join(b, (F.col("tid") == F.col("t")) & (F.col("i1") < F.col("i2"))).groupBy("i1", "i2").agg(F.sum(F.col("ptu") * F.col("p1") * F.col("p2")).alias("bound"))
