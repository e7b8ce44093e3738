"""Running values of a key in order, for keys of any size.

Rows are dealt by ranges of key and order, so a key with many rows lies over many tasks. Each range is scanned alone;
what the ranges before it come to is worked out on one row a key and range, and added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written_once

RANGE = "_range"


def ranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """``df`` dealt by ranges of ``key`` and ``order`` (nulls first), with the number of the range. It is written once, as Spark reads it twice."""
    return written_once(df.repartitionByRange(key, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def with_carried(dealt: DataFrame, key: str, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """``dealt`` with values carried into each range of a key: ``summary`` are aggregates of a range, ``carry`` what is worked out of them over the ranges of the key."""
    each = dealt.groupBy(key, RANGE).agg(*(v.alias(k) for k, v in summary.items()))
    carried = each.select(F.col(key).alias("_key"), F.col(RANGE).alias("_no"), *(v.alias(k) for k, v in carry.items()))
    return dealt.join(carried, dealt[key].eqNullSafe(carried["_key"]) & (dealt[RANGE] == carried["_no"]), "left").drop("_key", "_no")


def ranges_before(key: str, descending: bool = False):
    """The ranges of a key before one, in order."""
    return Window.partitionBy(key).orderBy(F.desc(RANGE) if descending else F.asc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)


def within(key: str, *order: Column | str):
    """The rows of a key within a range, up to each one."""
    return Window.partitionBy(key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
