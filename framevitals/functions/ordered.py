"""Work along a global order without a task that sees all rows: ranges, and what one range hands to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framevitals.sources.scratch import checkpointed


def in_parts(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order``, with the number of their ``part``; stored, so that the numbers stay."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def last_before(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """``rows`` with ``value`` filled from the last row, in ``order``, that has one.

    Within a part the value is carried along the sorted rows; what a part starts with is the last value of the parts before it: one
    row for each part.
    """
    parts = in_parts(rows, *order)
    along = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.where(F.col(value).isNotNull()).groupBy("part").agg(F.max_by(value, F.struct(*order)).alias("end"))
    every = parts.select("part").distinct().join(ends, "part", "left")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = every.select("part", F.last("end", ignorenulls=True).over(earlier).alias("start"))
    carried = F.last(value, ignorenulls=True).over(along)
    found = parts.withColumn(value, carried).join(F.broadcast(start), "part")  # as many rows as parts
    return found.withColumn(value, F.coalesce(value, "start")).drop("part", "start")
