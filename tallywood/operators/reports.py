"""Sinks and run reports. A result has K rows at most, so reports are made on the driver."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions import itemset_line
from .statistics import Statistics


def write_results_csv(result: DataFrame, path: str) -> None:
    """rank,items,expected_utility,existential_probability,size with six decimals; items as "[a, b]", sorted."""
    items = F.concat(F.lit("["), F.array_join(F.col("items").cast("array<string>"), ", "), F.lit("]"))
    out = result.orderBy("rank").select("rank", items.alias("items"), F.format_string("%.6f", "eu").alias("expected_utility"), F.format_string("%.6f", "ep").alias("existential_probability"), "size")
    out.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_results_text(result: DataFrame, path: str) -> None:
    """Lines of rank | items | EU | EP | size."""
    result.orderBy("rank").select(F.concat_ws(" | ", F.col("rank").cast("string"), itemset_line())).coalesce(1).write.mode("overwrite").text(path)


def results_csv(rows: list) -> str:
    """The same table as ``write_results_csv`` makes, of collected rows."""
    return "rank,items,expected_utility,existential_probability,size\n" + "".join(f'{r["rank"]},"[{", ".join(map(str, r["items"]))}]",{r["eu"]:.6f},{r["ep"]:.6f},{r["size"]}\n' for r in rows)


def results_text(cfg: MiningConfig, rows: list, now: datetime | None = None) -> str:
    """A header of comment lines, then rank | items | EU | EP | size."""
    head = ["# Top-K expected-utility itemsets", f"# {now or datetime.now():%Y-%m-%d %H:%M:%S}", f"# k={cfg.k} min_probability={cfg.min_probability}", f"# found={len(rows)}", "# rank | items | EU | EP | size"]
    return "\n".join([*head, *(f"{r['rank']} | {','.join(map(str, r['items']))} | {r['eu']:.6f} | {r['ep']:.6f} | {r['size']}" for r in rows)]) + "\n"


def statistics_text(cfg: MiningConfig, rows: list, statistics: Statistics) -> str:
    """Settings, counters over all levels, and the result's range."""
    lines = [f"k={cfg.k}", f"min_probability={cfg.min_probability}", f"strategy={cfg.strategy}", f"policy={cfg.policy}", f"found={len(rows)}"]
    lines += [f"{k}={v}" for k, v in statistics.breakdown().items()] + [f"share_{k}={v:.4f}" for k, v in statistics.effectiveness().items()]
    if rows:
        lines += [f"max_eu={rows[0]['eu']:.6f}", f"min_eu={min(r['eu'] for r in rows):.6f}", f"avg_ep={sum(r['ep'] for r in rows) / len(rows):.6f}", f"max_size={max(r['size'] for r in rows)}"]
    return "\n".join(lines) + "\n"


def details_text(cfg: MiningConfig, rows: list, statistics: Statistics) -> str:
    """Level by level counters, then each itemset with its density and score."""
    lines = [cfg.to_json(), *statistics.lines(), "rank,items,eu,ep,size,density,score"]
    return "\n".join([*lines, *(f"{r['rank']},{' '.join(map(str, r['items']))},{r['eu']:.6f},{r['ep']:.6f},{r['size']},{r['eu'] / r['size']:.6f},{r['eu'] * r['ep']:.6f}" for r in rows)]) + "\n"


def console_lines(result: DataFrame | list) -> list[str]:
    """``rank. {i, j} EU=... EP=...`` for a result's at most K rows."""
    rows = result if isinstance(result, list) else result.orderBy("rank").collect()
    return [f"{r['rank']}. {{{', '.join(map(str, r['items']))}}} EU={r['eu']:.4f} EP={r['ep']:.4f}" for r in rows]


class Profiler:
    """Exclusive seconds by component."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}
        self._open: list[list] = []

    @contextmanager
    def component(self, name: str):
        began = time.perf_counter()
        self._open.append([name, 0.0])
        try:
            yield
        finally:
            took = time.perf_counter() - began
            _, inner = self._open.pop()
            self.seconds[name] = self.seconds.get(name, 0.0) + took - inner
            if self._open:
                self._open[-1][1] += took

    def csv(self) -> str:
        total = sum(self.seconds.values()) or 1.0
        return "component,exclusive_time_ms,percentage\n" + "".join(f"{k},{1000 * v:.2f},{100 * v / total:.2f}\n" for k, v in self.seconds.items())


def summary(cfg: MiningConfig, result: DataFrame | list, profiler: Profiler | None = None, statistics: Statistics | None = None) -> str:
    """Parameters, profile, counters and ranked list as text."""
    lines = [f"# {datetime.now():%Y-%m-%d %H:%M:%S}", f"k={cfg.k} min_probability={cfg.min_probability} strategy={cfg.strategy}"]
    counts = [f"{k}: {v}" for k, v in statistics.breakdown().items()] if statistics else []
    return "\n".join([*lines, *(profiler.csv().splitlines() if profiler else []), *counts, *console_lines(result)]) + "\n"
