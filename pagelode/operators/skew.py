"""Joins in which no key meets one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that count as hot, and fewest rows of one.
HOT_KEYS, HOT_ROWS = 10_000, 256


def dealt_join(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row for each key and how many rows of ``left`` hold it (``__n``).

    Keys of more rows than ``HOT_ROWS`` and a ``HOT_KEYS``-th of all ``total`` rows are fewer than ``HOT_KEYS``: they are
    broadcast, and their rows stay where they are. The others are shuffled.
    """
    if total <= HOT_ROWS:  # no key can hold more rows than there are
        return left.join(right.drop("__n"), key, how)
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(right.filter(F.col("__n") > limit).drop("__n"))
    cold = right.filter(F.col("__n") <= limit).drop("__n")
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return left.join(hot, key).select(*rest.columns).unionByName(rest)
