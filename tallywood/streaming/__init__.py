"""Item measures over a stream of transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON
from ..functions import existential_probability, expected_utility, unit_utility


def item_measures(stream: DataFrame, profits: DataFrame) -> DataFrame:
    """eu, ep and support of every item seen so far; ``stream``: (tid, item, qty, prob), each entry once.

    A stream-static join and one stateful aggregation, to be written in complete or update mode.
    """
    rows = stream.join(profits, "item").filter(F.col("prob") > EPSILON).withColumns({"u": unit_utility(), "logp": F.log("prob")})
    return rows.groupBy("item").agg(expected_utility().alias("eu"), existential_probability().alias("ep"), F.count("*").alias("support"))
