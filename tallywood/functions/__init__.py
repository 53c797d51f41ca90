"""Column builders: measures of itemsets and itemset algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPSILON, LOG_EPSILON


def unit_utility(profit="profit", qty="qty") -> Column:
    return F.col(profit) * F.col(qty)


def clamped_log(prob="prob") -> Column:
    """ln p, with values near 0 and 1 set to the limits."""
    p = F.col(prob)
    return F.when(p < EPSILON, LOG_EPSILON).when(p > 1 - EPSILON, 0.0).otherwise(F.log(F.greatest(p, F.lit(1e-300))))


def expected_utility(u="u", logp="logp") -> Column:
    return F.sum(F.col(u) * F.exp(logp))


def existential_probability(logp="logp") -> Column:
    """1 - prod(1 - P): certain as soon as one P is 1, where the logarithm would be null."""
    p = F.exp(logp)
    safe = F.least(p, F.lit(1 - EPSILON))
    return F.when(F.max(p) > 1 - EPSILON, 1.0).otherwise(-F.expm1(F.sum(F.log1p(-safe))))


def remaining_sum(rem="rem", logp="logp") -> Column:
    return F.sum(F.col(rem) * F.exp(logp))


def upper_bound(u="u", rem="rem", logp="logp") -> Column:
    """Bound of the expected utility of every extension, sound with negative profits as well."""
    return F.sum(F.greatest(F.col(u) + F.col(rem), F.lit(0.0)) * F.exp(logp))


def max_potential(u="u", rem="rem", logp="logp") -> Column:
    """EU plus remaining sum; no bound where profits are negative."""
    return expected_utility(u, logp) + remaining_sum(rem, logp)


def density(eu="eu", size="size") -> Column:
    return F.when(F.col(size) > 0, F.col(eu) / F.col(size)).otherwise(0.0)


def combined_score(eu="eu", ep="ep") -> Column:
    return F.col(eu) * F.col(ep)


def union(a, b) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersection(a, b) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def difference(a, b) -> Column:
    return F.array_sort(F.array_except(a, b))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_proper_subset(a, b) -> Column:
    return is_subset(a, b) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def jaccard(a, b) -> Column:
    """Size of intersection by size of union; 1 for two empty sets."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def itemset_line(delimiter: str = " | ") -> Column:
    """items, EU, EP and size as one line of text."""
    return F.concat_ws(delimiter, F.array_join(F.col("items").cast("array<string>"), ","), F.format_string("%.6f", "eu"), F.format_string("%.6f", "ep"), F.col("size").cast("string"))


def parse_itemset_line(line, delimiter: str = " | ") -> Column:
    f = F.split(line, r"\Q" + delimiter + r"\E")
    return F.struct(F.split(f[0], ",").cast("array<int>").alias("items"), f[1].cast("double").alias("eu"), f[2].cast("double").alias("ep"), f[3].cast("int").alias("size"))
