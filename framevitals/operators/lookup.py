"""Attach a looked-up value to every row of a large frame, whatever the skew of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framevitals.functions import columns as C

SMALL_BYTES = 32 << 20
ENTRY_BYTES = 64
HOT_SHARE = 0.001


def attach(df: DataFrame, key: Column, dictionary: DataFrame, out: str, small: int = SMALL_BYTES) -> DataFrame:
    """Add ``out`` to ``df``: the ``found`` of the dictionary entry whose ``value`` equals ``key``.

    ``dictionary`` has unique ``value``, ``found`` and ``n``, the rows of ``df`` with that value. Its bytes are measured: up to
    ``small`` it is broadcast. Beyond that the values with more than ``HOT_SHARE`` of all rows (so at most 1 / HOT_SHARE of
    them, and of those only as many bytes as may be broadcast, most frequent first) are broadcast, and rows with such a value, or with none,
    are never shuffled. The other rows shuffle plainly on both sides, so that Spark can split what is still uneven.
    """
    names = [C.ref(c) for c in df.columns]
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ("value", "found")), F.lit(ENTRY_BYTES))
    size = size.cast("bigint")
    total, rows = dictionary.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if total <= small:
        entries = dictionary.select(F.col("value").alias("__value"), F.col("found").alias("__found"))
        joined = df.join(F.broadcast(entries), key == F.col("__value"), "left")
        return joined.select(*names, F.col("__found").alias(out))
    limit = int(rows * HOT_SHARE)
    # a thousand entries at most; of long values only those that fit
    upto = F.sum(size).over(Window.orderBy(F.desc("n"), "value").rowsBetween(Window.unboundedPreceding, 0))
    frequent = dictionary.where(F.col("n") > limit).withColumn("__upto", upto).where(F.col("__upto") <= SMALL_BYTES).drop("__upto")
    dictionary = dictionary.join(F.broadcast(frequent.select("value", F.lit(True).alias("__top"))), "value", "left")
    hot = dictionary.where("__top").select(F.col("value").alias("__hot"), F.col("found").alias("__found"))
    cold = dictionary.where("__top is null").select(F.col("value").alias("__cold"), F.col("found").alias("__rare"))
    first = df.join(F.broadcast(hot), key == F.col("__hot"), "left")
    is_open = key.isNotNull() & F.col("__hot").isNull()
    settled = first.where(~is_open).select(*names, F.col("__found").alias(out))
    rare = first.where(is_open).join(cold, key == F.col("__cold"), "left").select(*names, F.col("__rare").alias(out))
    return settled.unionByName(rare)
