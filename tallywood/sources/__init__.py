"""Readers of transactions and profits, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = ("drop_transaction", "skip_entry", "fail")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines that are no comments, with an id that grows along each file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    return lines.filter((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_transactions(spark: SparkSession, path: str, on_error: str = "drop_transaction", require_positive_qty: bool = False) -> DataFrame:
    """tid, item, qty, prob from lines of ``item:quantity:probability`` entries; a repeated item's last entry counts.

    ``on_error``: a faulty entry drops its transaction, is skipped, or fails the read. Any unique tid serves.
    """
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be one of {POLICIES}")
    entries = _numbered(spark, path).select("line", F.posexplode(F.split("value", r"\s+")).alias("place", "entry")).withColumn("f", F.split("entry", ":"))
    field = lambda i, kind: F.get("f", F.lit(i)).try_cast(kind)
    entries = entries.select("line", "place", (F.size("f") == 3).alias("three"), field(0, "int").alias("item"), field(1, "bigint").alias("qty"), field(2, "double").alias("prob"))
    good = F.col("three") & F.col("item").isNotNull() & F.col("qty").isNotNull() & F.col("prob").isNotNull() & F.col("prob").between(0, 1)
    if require_positive_qty:
        good = good & (F.col("qty") > 0)
    entries = entries.withColumn("good", F.coalesce(good, F.lit(False)))
    if on_error == "fail" and not entries.filter(~F.col("good")).isEmpty():
        raise ValueError(f"{path}: faulty entries")
    if on_error == "drop_transaction":
        bad = entries.groupBy("line").agg(F.bool_and("good").alias("all_good")).filter("all_good").select("line")
        entries = entries.join(bad, "line", "left_semi")
    kept = entries.filter("good").groupBy("line", "item").agg(F.max_by(F.struct("qty", "prob"), "place").alias("v"))
    return kept.select(F.col("line").alias("tid"), "item", "v.qty", "v.prob")


def read_profits(spark: SparkSession, path: str, on_error: str = "skip_entry") -> DataFrame:
    """item, profit from lines of two fields; of repeated items the last line counts."""
    f = F.split("value", r"\s+")
    rows = _numbered(spark, path).select("line", F.size(f).alias("n"), F.get(f, F.lit(0)).try_cast("int").alias("item"), F.get(f, F.lit(1)).try_cast("double").alias("profit"))
    good = (F.col("n") == 2) & F.col("item").isNotNull() & F.col("profit").isNotNull()
    if on_error == "fail" and not rows.filter(~good).isEmpty():
        raise ValueError(f"{path}: faulty lines")
    return rows.filter(good).groupBy("item").agg(F.max_by("profit", "line").alias("profit"))


def validate(transactions: DataFrame, profits: DataFrame) -> None:
    """Fails on empty inputs and on probabilities outside 0 to 1."""
    if transactions.isEmpty() or profits.isEmpty():
        raise ValueError("transactions and profits must not be empty")
    if not transactions.filter(F.col("prob").isNull() | ~F.col("prob").between(0, 1)).isEmpty():
        raise ValueError("probabilities must lie between 0 and 1")


def order_transactions(spark: SparkSession, sf_dir: str, item: str = "brand") -> tuple[DataFrame, DataFrame]:
    """Uncertain transactions and signed profits derived from the order tables; items are brands or parts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    if item == "brand":
        items = part.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("item"))
        lines = lines.join(items, lines.l_partkey == items.p_partkey)
    else:
        items = part.select(F.col("p_partkey").cast("int").alias("item"))
        lines = lines.withColumn("item", F.col("l_partkey").cast("int"))
    # Dealt by transaction once: entries, utilities of transactions and ranks need no further shuffle.
    tx = lines.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("tid"), "item").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.round(0.95 - 5 * F.max("l_discount"), 2).alias("prob"))
    return tx, signed_profits(items)


def signed_profits(items: DataFrame) -> DataFrame:
    """item, profit of every item of a table: 1 to 7, every fifth one negative."""
    sign = F.when(F.col("item") % 5 == 0, -1.0).otherwise(1.0)
    return items.select("item").distinct().withColumn("profit", sign * (1 + F.col("item") % 7))


def write_transactions(tx: DataFrame, path: str) -> None:
    """One line of ``item:quantity:probability`` entries a transaction, items in order."""
    entry = F.concat_ws(":", F.col("item").cast("string"), F.col("qty").cast("string"), F.col("prob").cast("string"))
    tx.groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", entry.alias("e")))), lambda x: x["e"]), " ").alias("value")).select("value").write.text(path)


def write_profits(profits: DataFrame, path: str) -> None:
    profits.select(F.concat_ws(" ", F.col("item").cast("string"), F.col("profit").cast("string")).alias("value")).write.text(path)
