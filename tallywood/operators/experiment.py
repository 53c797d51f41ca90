"""A single experiment: read, validate, mine, repeat, report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..config import ExperimentConfig, MiningConfig
from ..sources import read_profits, read_transactions, validate
from .mine import mine
from .reports import Profiler, details_text, results_csv, results_text, statistics_text, summary
from .statistics import Statistics
from .store import write_file


@dataclass(frozen=True)
class Outcome:
    """A run's result, its counters and profile, the seconds of each repetition, and the files written."""

    result: DataFrame
    statistics: Statistics
    profiler: Profiler
    seconds: list[float]
    files: dict[str, str]


def write_reports(spark: SparkSession, folder: str, name: str, cfg: MiningConfig, result: DataFrame, profiler: Profiler, statistics: Statistics, export_stats: bool = False, debug: bool = False, now: datetime | None = None) -> dict[str, str]:
    """Files <name>_<time>_results.csv, _profile.csv and _summary.txt in a folder, and on demand _stats.txt and _detailed.txt."""
    stem = f"{folder.rstrip('/')}/{name}_{now or datetime.now():%Y%m%d_%H%M%S}"
    rows = result.orderBy("rank").collect()  # K at most
    made = {"results.csv": results_csv(rows), "profile.csv": profiler.csv(), "summary.txt": summary(cfg, rows, profiler, statistics), "results.txt": results_text(cfg, rows, now)}
    if export_stats:
        made["stats.txt"] = statistics_text(cfg, rows, statistics)
    if debug:
        made["detailed.txt"] = details_text(cfg, rows, statistics)
    return {kind: write_file(spark, f"{stem}_{kind}", text) for kind, text in made.items()}


def run_experiment(spark: SparkSession, run: ExperimentConfig, cfg: MiningConfig | None = None) -> Outcome:
    """Every repetition starts anew; the reports are of the last one."""
    cfg = cfg or MiningConfig()
    profiler, statistics, result = Profiler(), Statistics(), None
    seconds = []
    with profiler.component("LOADING"):
        tx, profits = read_transactions(spark, run.transactions, run.on_error).persist(), read_profits(spark, run.profits).persist()
        validate(tx, profits)
    for _ in range(run.repetitions):
        statistics = Statistics()
        before = profiler.seconds.get("SEARCH", 0.0)
        with profiler.component("SEARCH"):
            result = mine(tx, profits, cfg, statistics=statistics)
        seconds.append(profiler.seconds["SEARCH"] - before)
    files = write_reports(spark, run.output, run.name, cfg, result, profiler, statistics, run.export_stats, run.debug)
    tx.unpersist(), profits.unpersist()
    return Outcome(result, statistics, profiler, seconds, files)
