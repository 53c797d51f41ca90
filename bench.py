"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from tallywood.plans.queries import queries

HEADLINE = ["ptwu_per_item", "suffix_remaining_utility", "single_item_measures", "pair_measures", "eucs_pairs", "topk_mixed_levelwise", "topk_mixed_powerset", "topk_mixed_prefix", "topk_parts", "topk_high_min_prob", "sweep_k_minprob"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, took = queries(), {}
    found["ptwu_per_item"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
