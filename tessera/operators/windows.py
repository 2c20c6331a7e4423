"""Window frames that Spark SQL does not parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .builder import free_name, sort_key


def groups_frame(df: DataFrame, function: Column, name: str, partition: list[str], order: list[str], first: int | None, last: int | None) -> DataFrame:
    """function over (partition by .. order by .. GROUPS between first and last): peers are numbered, then ranged over.

    first and last count groups of peers from the current one, negative before it; None is unbounded.
    """
    w = Window.partitionBy(*partition)
    peer = free_name(df, "_peer")
    numbered = df.withColumn(peer, F.dense_rank().over(w.orderBy(*map(sort_key, order))))
    lo, hi = Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last
    return numbered.withColumn(name, function.over(w.orderBy(peer).rangeBetween(lo, hi))).drop(peer)
