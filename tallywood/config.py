"""Settings of a mining run and of an experiment."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from pathlib import Path

#: Fixed values of the measures: slack of comparisons, and the log-probability that counts as none.
EPSILON, LOG_EPSILON = 1e-10, -700.0
#: Sums are rounded to six decimals where they decide an order; values this near may tie.
TIE = 1e-6
STRATEGIES = ("levelwise", "powerset", "prefix")
#: Names of search orders that users may have; all give the same answer.
SEARCH_NAMES = {
    "BFS": "levelwise", "BREADTH_FIRST": "levelwise", "BREADTHFIRSTSEARCH": "levelwise", "DFS": "prefix", "DEPTH_FIRST": "prefix", "DEPTHFIRSTSEARCH": "prefix",
    "BEFS": "levelwise", "BEST_FIRST": "levelwise", "BESTFIRSTSEARCH": "levelwise",
}
#: Pruning policies by name, and whether they test existential probability before the result is filtered.
POLICIES = {"composite": True, "ep_focused": True, "bulk_focused": True, "eu_focused": False}


@dataclass(frozen=True)
class MiningConfig:
    """``k`` best itemsets whose existential probability reaches ``min_probability``; ``max_depth``: most items (0: any).

    ``pair_prune``: the levelwise search tests pairs of items before it joins them, for many items and long transactions.
    """

    k: int = 10
    min_probability: float = 0.1
    strategy: str = "levelwise"
    max_depth: int = 0
    ep_prune: bool = True
    policy: str = "composite"
    pair_prune: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "strategy", SEARCH_NAMES.get(self.strategy.upper(), self.strategy))
        object.__setattr__(self, "policy", self.policy.lower())
        if self.k < 1 or not 0 <= self.min_probability <= 1 or self.max_depth < 0 or self.strategy not in STRATEGIES or self.policy not in POLICIES:
            raise ValueError(f"invalid settings: {self}")

    @property
    def tests_probability(self) -> bool:
        return self.ep_prune and POLICIES[self.policy]

    @classmethod
    def from_json(cls, text: str) -> MiningConfig:
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, path: str) -> MiningConfig:
        return cls.from_json(Path(path).read_text())

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json() + "\n")


@dataclass(frozen=True)
class ExperimentConfig:
    """A run over two text files: its name, report folder, repetitions, reader's policy, and which extra reports to write."""

    transactions: str
    profits: str
    output: str = "output"
    name: str = "run"
    repetitions: int = 1
    on_error: str = "drop_transaction"
    export_stats: bool = False
    debug: bool = False

    def __post_init__(self) -> None:
        if self.repetitions < 1 or not self.name or "/" in self.name:
            raise ValueError(f"invalid settings: {self}")
