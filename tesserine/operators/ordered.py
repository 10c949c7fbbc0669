"""Positions and running sums over a total order, without bringing a group into one task.

The rows are range-partitioned by (group, order), so even a group with a third of all rows is spread over many
partitions. Only one small row per (group, partition) is summed up across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.sources.durable import keep

_SHIFT = 33  # monotonically_increasing_id: the partition number stands above these bits


def ordered(df: DataFrame, group: list[str], order: list[Column], name: str = "ordered") -> DataFrame:
    """`df` in a total order of (group, order), written once, with `_pos` rising in that order and `_part`."""
    keys = [*map(F.col, group), *order]
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    return keep(rows, name).withColumn("_part", F.shiftrightunsigned("_pos", _SHIFT).cast("int"))


def _before(parts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds `_before`: the sum of `value` over the group's earlier partitions; parts: a row per (group, partition)."""
    if group:
        earlier = Window.partitionBy(*group).orderBy("_part")
        return parts.withColumn("_before", F.coalesce(F.sum(value).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    earlier = Window.orderBy("_part")  # one row per partition of the whole table
    return parts.withColumn("_before", F.coalesce(F.sum(value).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def with_rank(rows: DataFrame, group: list[str], rank: str = "rank") -> DataFrame:
    """Rows of `ordered` with their 1-based rank within the group."""
    parts = rows.groupBy(*group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    parts = _before(parts, group, "_n").select(*group, "_part", "_first", "_before")
    joined = rows.join(parts, [*group, "_part"])
    return joined.withColumn(rank, F.col("_before") + F.col("_pos") - F.col("_first") + 1).drop("_before", "_first")


def with_running_sum(rows: DataFrame, group: list[str], value: str, total: str) -> DataFrame:
    """Rows of `ordered` with the sum of `value` (an integer) over the group's rows up to and with them."""
    parts = rows.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    parts = _before(parts, group, "_sum").select(*group, "_part", "_before")
    inside = Window.partitionBy(*group, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(parts, [*group, "_part"]).withColumn(total, F.col("_before") + F.col("_inside")).drop("_before", "_inside")
