"""Dense numbers in a given order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.work import saved

_PART, _START = "__part", "__start"


def number(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``df`` with ``name`` = ``start`` + 1, 2, … in the order, which must have no ties.

    Rows are range-partitioned by the order and written once, so that every later reading sees the same ranges; each
    range is numbered by itself and begins after the counts of those before it (one row for each partition).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(_PART).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(_PART, F.coalesce(before, F.lit(0)).alias(_START))
    inside = F.row_number().over(W.partitionBy(_PART).orderBy(*order))
    return ranged.join(F.broadcast(starts), _PART).withColumn(name, F.col(_START) + inside + F.lit(start)).drop(_PART, _START)
