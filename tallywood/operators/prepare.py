"""Transaction and item bounds, item order, utility rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPSILON, LOG_EPSILON
from ..functions import existential_probability, expected_utility, remaining_sum, unit_utility, upper_bound
from .store import kept


def with_profit(tx: DataFrame, profits: DataFrame) -> DataFrame:
    """Entries whose item has a profit, with their utility; adaptive execution broadcasts profits if small."""
    return tx.join(profits.filter(F.col("profit").isNotNull()), "item").withColumn("u", unit_utility())


def transaction_utilities(tx: DataFrame, profits: DataFrame) -> DataFrame:
    """tid, ptu (positive), ntu (negative), rtu (remaining: positive), total; items of probability 0 count."""
    u, gain = F.col("u"), F.col("profit") > EPSILON
    return with_profit(tx, profits).groupBy("tid").agg(F.sum(F.when(gain, u).otherwise(0.0)).alias("ptu"), F.sum(F.when(~gain, u).otherwise(0.0)).alias("ntu"), F.sum(F.when(gain, u).otherwise(0.0)).alias("rtu"), F.sum(u).alias("total"))


def usable(tx: DataFrame, profits: DataFrame) -> DataFrame:
    """tid, item, qty, prob, profit, u, ptu of entries with a probability."""
    ptu = F.sum(F.when(F.col("profit") > EPSILON, F.col("u")).otherwise(0.0)).over(Window.partitionBy("tid"))
    return with_profit(tx, profits).withColumn("ptu", ptu).filter(F.col("prob") > EPSILON)


def item_bounds(tx: DataFrame, profits: DataFrame) -> DataFrame:
    """item, ptwu (sum of ptu), rtwu (weighted by probability), prob_sum."""
    return usable(tx, profits).groupBy("item").agg(F.sum("ptu").alias("ptwu"), F.sum(F.col("ptu") * F.col("prob")).alias("rtwu"), F.sum("prob").alias("prob_sum"))


def item_ranks(bounds: DataFrame) -> DataFrame:
    """item, ptwu, rank: ascending ptwu, then item; ranks are 0, 1, ... without gaps.

    Items are sorted by ranges and numbered within them; the driver learns one count a range.
    """
    ordered = kept(bounds.select("item", "ptwu").repartitionByRange(F.round("ptwu", 6), "item").sortWithinPartitions(F.round("ptwu", 6), "item"))
    numbered = ordered.withColumn("id", F.monotonically_increasing_id()).select("item", "ptwu", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND((1 << 33) - 1).alias("place"))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, numbered.groupBy("part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = bounds.sparkSession.createDataFrame(offsets, "part long, start long")
    return numbered.join(F.broadcast(starts), "part").select("item", "ptwu", (F.col("start") + F.col("place")).cast("int").alias("rank"))


def sort_by_rank(df: DataFrame, ranks: DataFrame) -> DataFrame:
    """``df`` with its items' rank, in rank order, items without one last."""
    return df.join(ranks.select("item", "rank"), "item", "left").orderBy(F.col("rank").asc_nulls_last(), "item")


def ranked_rows(usable_rows: DataFrame, few_items: bool = False) -> DataFrame:
    """tid, item, rank, u, rem (positive utility after the item in its transaction), logp, ptwu, ptu.

    ``rank`` is the item's place in its transaction, by the order that all transactions share (ptwu, then item), so
    no global numbering is needed. ``few_items``: the table of items is known to be small and travels to the tasks,
    which leaves the rows where they are.
    """
    ptwu = usable_rows.groupBy("item").agg(F.sum("ptu").alias("ptwu"))
    order = Window.partitionBy("tid").orderBy(F.round("ptwu", 6), "item")
    later = order.rowsBetween(1, Window.unboundedFollowing)
    rows = usable_rows.join(F.broadcast(ptwu) if few_items else ptwu, "item")
    rows = rows.withColumns({"rank": F.row_number().over(order), "rem": F.coalesce(F.sum(F.greatest("u", F.lit(0.0))).over(later), F.lit(0.0))})
    return rows.select("tid", "item", "rank", "u", "rem", F.log("prob").alias("logp"), "ptwu", "ptu").filter(F.col("logp") > LOG_EPSILON)


def utility_rows(tx: DataFrame, profits: DataFrame) -> DataFrame:
    return ranked_rows(usable(tx, profits))


def rank_faults(rows: DataFrame) -> DataFrame:
    """Utility rows whose item comes after one of a larger ptwu in its transaction: none if ranks are right."""
    before = F.lag(F.round("ptwu", 6)).over(Window.partitionBy("tid").orderBy("rank"))
    return rows.withColumn("before_", before).filter(F.col("before_") > F.round("ptwu", 6)).drop("before_")


def itemset_in_transactions(tx: DataFrame, profits: DataFrame, items: list[int]) -> DataFrame:
    """tid, contained, utility, prob, logp of an itemset in every transaction that has a part of it.

    utility: of the items that are there; prob: the product of all, 0 unless all are there; logp: its logarithm, or
    the one that counts as none.
    """
    wanted = sorted(set(items))
    some = usable(tx, profits).filter(F.col("item").isin(wanted)).groupBy("tid").agg(F.count("*").alias("n"), F.sum(F.log("prob")).alias("l"), F.product("prob").alias("p"), F.sum("u").alias("utility"))
    whole = F.col("n") == len(wanted)
    return some.select("tid", whole.alias("contained"), "utility", F.when(whole, F.col("p")).otherwise(0.0).alias("prob"), F.when(whole, F.col("l")).otherwise(LOG_EPSILON).alias("logp"))


def measures(rows: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """eu, ep, rem_sum, bound, support and further aggregates of each group of utility rows."""
    return rows.groupBy(*keys).agg(expected_utility().alias("eu"), existential_probability().alias("ep"), remaining_sum().alias("rem_sum"), upper_bound().alias("bound"), F.count("*").alias("support"), *[c.alias(name) for name, c in more.items()])
