"""Mutual information of a discrete and a continuous variable from nearest neighbours (Ross, 2014), without bins.

For a point with label c and value x, r is the distance to its k-th nearest other point of the same label, and m the number
of all points closer than r (itself included; with r = 0 the points equal to it). The estimate is the mean of
psi(N) + psi(k) - psi(n_c) - psi(m). A label with n_c points uses k = n_c - 1 where that is less; labels with one
point are left out, as are rows without label or value. Equal points are one row with a count, so copies cost nothing
and ties are defined: r counts copies as neighbours at distance 0.

Neighbours in one dimension are neighbours in sorted order. Points are dealt by ranges of (feature, label, value), so one
label may span many tasks; the first and last rows of each range are put together once more to see over its borders.
Points within r come from running counts over ranges of (feature, value), each bound being an event between the points.
No pairs of points are formed, and no task holds a label or a feature whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framevitals.functions.ordered import in_parts
from framevitals.sources.scratch import checkpointed

NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1: eight steps up, then the asymptotic series."""
    n = n.cast("double")
    z = n + 8.0
    steps = sum((1.0 / (n + float(j)) for j in range(1, 8)), 1.0 / n)
    q = 1.0 / (z * z)
    return F.ln(z) - 0.5 / z - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - steps


def _around(rows: DataFrame, group: tuple[str, ...], k: int) -> DataFrame:
    """``near``: the k values on either side within the group as (distance, count), nearest first."""
    order = Window.partitionBy(*group).orderBy("x")
    sides = [F.struct((F.col("x") - F.lag("x", j).over(order)).alias("d"), F.lag("w", j).over(order).alias("w")) for j in range(1, k + 1)]
    sides += [F.struct((F.lead("x", j).over(order) - F.col("x")).alias("d"), F.lead("w", j).over(order).alias("w")) for j in range(1, k + 1)]
    return rows.withColumn("near", F.array_sort(F.filter(F.array(*sides), lambda s: s["d"].isNotNull())))


def reach(k: str, w: str, near: str) -> Column:
    """Distance of the ``k``-th other point, where the point is there ``w`` times and ``near`` lists (d, w), nearest first."""
    start = F.struct((F.col(k) - F.col(w) + 1).alias("left"), F.lit(0.0).alias("r"))
    return F.aggregate(
        near,
        start,
        lambda had, s: F.when(had["left"] <= 0, had).otherwise(F.struct((had["left"] - s["w"]).alias("left"), s["d"].alias("r"))),
        lambda had: had["r"],
    )


def _radii(points: DataFrame, k: int) -> DataFrame:
    """f, c, x, w, n_c, k and r of each distinct point of a label with two points or more."""
    sizes = points.groupBy("f", "c").agg(F.sum("w").alias("n_c")).where("n_c > 1")
    parts = in_parts(points, "f", "c", "x")
    here = ("part", "f", "c")
    place = F.row_number().over(Window.partitionBy(*here).orderBy("x"))
    rest = F.row_number().over(Window.partitionBy(*here).orderBy(F.desc("x")))
    near = _around(parts, here, k).withColumn("place", F.least(place, rest))
    span = parts.groupBy("f", "c").agg((F.max("part") > F.min("part")).alias("spans"))
    near = near.join(span, ["f", "c"])
    edge = F.col("spans") & (F.col("place") <= k)
    inner = near.where(~edge)
    # at most 4 k rows of a label and part
    across = _around(near.where(F.col("spans") & (F.col("place") <= 2 * k)).drop("near"), ("f", "c"), k).where(F.col("place") <= k)
    both = inner.unionByName(across).join(sizes, ["f", "c"])
    both = both.withColumn("k", F.least(F.lit(k).cast("long"), F.col("n_c") - 1))
    return both.select("f", "c", "x", "w", "n_c", "k", reach("k", "w", "near").alias("r"))


def within(radii: DataFrame) -> DataFrame:
    """``radii`` as (f, w, n_c, k, m): m points of the feature lie closer than r."""
    data = radii.groupBy("f", F.col("x").alias("v")).agg(F.sum("w").alias("add")).withColumn("s", F.lit(1))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("c", radii.schema["c"].dataType), ("x", "double"), ("w", "long"), ("n_c", "long"), ("k", "long"))]
    data = data.select("f", "v", "s", "add", *none, F.lit(0).alias("sign"))
    same = F.col("r") == 0
    # s orders events of one value: 0 before the points that have it, 2 after them
    low = F.struct((F.col("x") - F.col("r")).alias("v"), F.when(same, 0).otherwise(2).alias("s"), F.lit(-1).alias("sign"))
    high = F.struct((F.col("x") + F.col("r")).alias("v"), F.when(same, 2).otherwise(0).alias("s"), F.lit(1).alias("sign"))
    asked = radii.select("f", F.explode(F.array(low, high)).alias("e"), "c", "x", "w", "n_c", "k")
    asked = asked.select("f", "e.v", "e.s", F.lit(0).cast("long").alias("add"), "c", "x", "w", "n_c", "k", "e.sign")
    parts = in_parts(data.unionByName(asked), "f", "v", "s")
    totals = parts.groupBy("part", "f").agg(F.sum("add").alias("total"))
    before = F.sum("total").over(Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part and one more for each feature, at most
    earlier = F.broadcast(totals.select("part", "f", F.coalesce(before, F.lit(0)).alias("before")))
    running = F.sum("add").over(Window.partitionBy("part", "f").orderBy("v", "s").rowsBetween(Window.unboundedPreceding, 0))
    counted = parts.withColumn("upto", running).where("sign <> 0").join(earlier, ["part", "f"])
    m = F.sum(F.col("sign") * (F.col("upto") + F.col("before"))).alias("m")
    return counted.groupBy("f", "c", "x").agg(F.first("w").alias("w"), F.first("n_c").alias("n_c"), F.first("k").alias("k"), m)


def neighbour_information(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(f, mi): mutual information in nats of c and x for each f; ``rows`` has f, c and x (double, without NaN)."""
    points = rows.where("c is not null and x is not null").groupBy("f", "c", F.expr("x + 0.0D").alias("x")).agg(F.count(F.lit(1)).alias("w"))
    found = within(checkpointed(_radii(points, k)))
    w = F.col("w").cast("double")
    mean = F.sum(w * (digamma(F.col("k")) - digamma(F.col("n_c")) - digamma(F.col("m")))) / F.sum(w)
    return found.groupBy("f").agg(F.greatest(F.lit(0.0), digamma(F.sum("w")) + mean).alias("mi"))
