"""Counters of a run: itemsets generated and pruned by kind, and the threshold, level by level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON, MiningConfig


@dataclass
class Statistics:
    """One dictionary a level: level, generated, qualified, pruned_ep, pruned_bound, kept, threshold."""

    levels: list[dict] = field(default_factory=list)

    def level(self, size: int, judged: DataFrame, least: float, cfg: MiningConfig) -> None:
        """Counts a level's itemsets (items, eu, ep, bound); a set that fails both tests counts for its probability."""
        unlikely = (F.col("ep") < cfg.min_probability - EPSILON) if cfg.tests_probability else F.lit(False)
        low = ~unlikely & (F.col("bound") < least - EPSILON)
        good = (F.col("eu") >= least - EPSILON) & (F.col("ep") >= cfg.min_probability - EPSILON)
        n, q, e, b = judged.agg(F.count("*"), F.count_if(good), F.count_if(unlikely), F.count_if(low)).first()
        self.levels.append({"level": size, "generated": n, "qualified": q, "pruned_ep": e, "pruned_bound": b, "kept": n - e - b, "threshold": least})

    def total(self, name: str) -> int:
        return sum(x[name] for x in self.levels)

    def breakdown(self) -> dict[str, int]:
        return {k: self.total(k) for k in ("generated", "qualified", "pruned_ep", "pruned_bound", "kept")}

    def thresholds(self) -> list[tuple[int, float]]:
        return [(x["level"], x["threshold"]) for x in self.levels]

    def effectiveness(self) -> dict[str, float]:
        """Shares of the generated itemsets that each test pruned, and that any did."""
        n = self.total("generated") or 1
        each = {k: self.total(k) / n for k in ("pruned_ep", "pruned_bound")}
        return each | {"pruned": sum(each.values())}

    def lines(self) -> list[str]:
        names = ("level", "generated", "qualified", "pruned_ep", "pruned_bound", "kept", "threshold")
        return [",".join(names), *(",".join(f"{x[n]:.6f}" if n == "threshold" else str(x[n]) for n in names) for x in self.levels)]
