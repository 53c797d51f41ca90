"""Command line: mines two text files and writes the reports."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import POLICIES, ExperimentConfig, MiningConfig
from .operators.experiment import run_experiment
from .operators.reports import console_lines


def parsed(args: list[str] | None = None) -> tuple[ExperimentConfig, MiningConfig, bool]:
    p = argparse.ArgumentParser(prog="tallywood", description="Top-K expected-utility itemsets of uncertain transactions.")
    p.add_argument("transactions"), p.add_argument("profits")
    p.add_argument("k", type=int, nargs="?"), p.add_argument("min_probability", type=float, nargs="?")
    p.add_argument("-o", "--output", default="output"), p.add_argument("-n", "--name", default="run")
    p.add_argument("-r", "--repetitions", type=int, default=1), p.add_argument("-c", "--config", help="a JSON file of settings")
    p.add_argument("--strategy"), p.add_argument("--policy", choices=sorted(POLICIES)), p.add_argument("--max-depth", type=int)
    p.add_argument("--on-error", default="drop_transaction"), p.add_argument("--export-stats", action="store_true")
    p.add_argument("-d", "--debug", action="store_true"), p.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(args)
    base = MiningConfig.load(a.config) if a.config else MiningConfig()
    given = {n: getattr(a, n) for n in ("k", "min_probability", "strategy", "policy", "max_depth") if getattr(a, n) is not None}
    return ExperimentConfig(a.transactions, a.profits, a.output, a.name, a.repetitions, a.on_error, a.export_stats, a.debug), replace(base, **given), a.verbose


def main(args: list[str] | None = None) -> int:
    run, cfg, verbose = parsed(args)
    spark = SparkSession.builder.appName(f"tallywood {run.name}").getOrCreate()
    done = run_experiment(spark, run, cfg)
    print("\n".join(console_lines(done.result)))
    if verbose:
        print("\n".join([*done.statistics.lines(), *(f"{kind}: {path}" for kind, path in done.files.items()), "seconds: " + ", ".join(f"{s:.2f}" for s in done.seconds)]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
