"""Mutual information of two continuous variables from nearest neighbours in the plane (Kraskov and others, 2004), without bins.

For a point (x, y), r is the distance to its k-th nearest other point in the maximum norm, and m_x, m_y the numbers of points
closer than r in x and in y (itself included; with r = 0 the points equal to it). The estimate is
psi(N) + psi(k) - mean(psi(m_x) + psi(m_y)), at least 0; fewer than k other points use all of them. y is first brought to the spread of x: it is
multiplied by the ratio of the standard deviations, rounded to ten binary digits so that products of ordinary numbers are exact and
ties stay ties. Rows where a side is NULL, NaN or infinite are left out. Equal points are one row with a count: a point that
holds a third of all rows is one row.

Points are dealt by ranges of (feature, x, y) into strips of about the square root of their number, so a frequent x is cut by its y.
Each strip searches its own points with a k-d tree; a point whose k-th neighbour so far lies farther than the box of another strip asks that
strip as well, and nothing else crosses. Only the boxes of the strips reach the driver: a row for each ``STRIP`` points or their
square root. The counts on either side are running counts over sorted ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framevitals.operators.neighbours import NEIGHBOURS, digamma, reach, within
from framevitals.sources.scratch import checkpointed

#: Points of a leaf at least, points of a strip at most (about), queries looked up together.
LEAF, STRIP, TOGETHER = 16, 4_000_000, 4096
FOUND = "f int, x double, y double, w long, bound double, d double, dw long, hit int"
ANSWER = "f int, x double, y double, w long, d double, dw long"


class Boxes:
    """A balanced k-d tree over boxes (or points), split level by level at the middle of each node's wider side."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        n = len(low)
        self.depth = max(0, int(math.log2(max(1, n / LEAF))))
        nodes = 1 << self.depth
        leaf = -(-n // nodes)
        # all leaves have one size: single entries are there twice, the second time marked as copies
        item = np.concatenate((np.arange(n), np.linspace(0, n - 1, nodes * leaf - n).astype(np.int64)))
        slots = np.arange(len(item))
        middle = low + (high - low) / 2
        for level in range(self.depth):
            slots = slots.reshape(1 << level, -1)
            at = middle[item[slots]]
            wide = np.argmax(at.max(axis=1) - at.min(axis=1), axis=1)
            order = np.argsort(np.take_along_axis(at, wide[:, None, None], axis=2)[:, :, 0], axis=1, kind="stable")
            slots = np.take_along_axis(slots, order, axis=1)
        self.item = item[slots].reshape(nodes, leaf)
        self.copy = (slots >= n).reshape(nodes, leaf)
        flat = self.item.ravel()
        self.low = [low[flat].reshape(1 << lv, -1, 2).min(axis=1) for lv in range(self.depth + 1)]
        self.high = [high[flat].reshape(1 << lv, -1, 2).max(axis=1) for lv in range(self.depth + 1)]

    def leaves(self, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, leaf) for the leaves whose box is closer than the query's bound."""
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        for level in range(self.depth + 1):
            if level:
                who, node = np.repeat(who, 2), (2 * node[:, None] + np.arange(2)).ravel()
            near = gap(q[who], self.low[level][node], self.high[level][node]) < bound[who]
            who, node = who[near], node[near]
        return who, node


def gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Distance from points to boxes in the maximum norm, 0 inside."""
    return np.maximum(np.maximum(low - q, q - high), 0.0).max(axis=-1)


def first_bounds(tree: Boxes, points: np.ndarray, k: int) -> np.ndarray:
    """For each point a value above the distance of its k-th nearest other point, from its own leaf; infinite where that has fewer."""
    out = np.full(len(points), np.inf)
    step = max(1, TOGETHER // tree.item.shape[1])
    for start in range(0, len(tree.item), step):
        item, copy = tree.item[start : start + step], tree.copy[start : start + step]
        at = points[item]
        d = np.abs(at[:, :, None, :] - at[:, None, :, :]).max(axis=3)
        d = np.where(copy[:, None, :], np.inf, d)
        if d.shape[2] > k:
            kth = np.partition(d, k, axis=2)[:, :, k]
            out[item[~copy]] = np.nextafter(kth[~copy], np.inf)
    return out


def nearest(tree: Boxes, points: np.ndarray, w: np.ndarray, q: np.ndarray, bound: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, distance, count) of at most ``k`` points nearest to each query and closer than its bound; ``own`` is itself (or -1)."""
    for start in range(0, len(q), TOGETHER):
        part = slice(start, start + TOGETHER)
        who, leaf = tree.leaves(q[part], bound[part])
        item = tree.item[leaf]
        d = np.abs(points[item] - q[part][who][:, None, :]).max(axis=2)
        keep = (d < bound[part][who][:, None]) & ~tree.copy[leaf] & (item != own[part][who][:, None])
        row, column = np.nonzero(keep)
        who, item, d = who[row], item[row, column], d[row, column]
        order = np.lexsort((d, who))
        who, item, d = who[order], item[order], d[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < k
        yield who[keep] + start, d[keep], w[item[keep]]


def _frame(f: int, points: np.ndarray, w: np.ndarray, who: np.ndarray, **columns) -> pd.DataFrame:
    return pd.DataFrame({"f": np.int32(f), "x": points[who, 0], "y": points[who, 1], "w": w[who], **columns})


def _own(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The search of a strip's points among themselves, and which other strips (``hit``) they must ask."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f, part = key
        points, w = rows[["x", "y"]].to_numpy(), rows["w"].to_numpy()
        everyone = np.arange(len(points))
        tree = Boxes(points, points)
        bound = first_bounds(tree, points, k)
        # itself with count 0, so that a point without neighbours has a row
        out = [_frame(f, points, w, everyone, bound=bound, d=0.0, dw=np.int64(0), hit=np.int32(-1))]
        closest = bound.copy()
        for who, d, dw in nearest(tree, points, w, points, bound, everyone, k):
            out.append(_frame(f, points, w, who, bound=bound[who], d=d, dw=dw, hit=np.int32(-1)))
            last = np.flatnonzero(np.diff(np.append(who, -1)))
            full = last[np.bincount(who, minlength=len(points))[who[last]] == k]
            closest[who[full]] = d[full]
        parts, low, high = boxes[f]
        strips = Boxes(low, high)
        for start in range(0, len(points), TOGETHER):
            q, limit = points[start : start + TOGETHER], closest[start : start + TOGETHER]
            who, leaf = strips.leaves(q, limit)
            item, copy = strips.item[leaf], strips.copy[leaf]
            near = gap(q[who][:, None, :], low[item], high[item]) < limit[who][:, None]
            row, column = np.nonzero(near & ~copy & (parts[item] != part))
            asks = who[row] + start
            out.append(_frame(f, points, w, asks, bound=closest[asks], d=np.nan, dw=np.int64(0), hit=parts[item[row, column]].astype(np.int32)))
        return pd.concat(out, ignore_index=True)

    return work


def _asked(k: int):
    """The search of a strip's points for the points of other strips."""

    def work(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        q, qw = asked[["x", "y"]].to_numpy(), asked["w"].to_numpy()
        out = [_frame(key[0], q, qw, np.zeros(0, np.int64), d=np.zeros(0), dw=np.zeros(0, np.int64))]
        if len(q) and len(rows):
            points, w = rows[["x", "y"]].to_numpy(), rows["w"].to_numpy()
            for who, d, dw in nearest(Boxes(points, points), points, w, q, asked["bound"].to_numpy(), np.full(len(q), -1), k):
                out.append(_frame(key[0], q, qw, who, d=d, dw=dw))
        return pd.concat(out, ignore_index=True)

    return work


def _points(rows: DataFrame) -> DataFrame:
    """f, x, y, w of the distinct points, y at the spread of x."""
    inside = [f"not isnan({c}) and abs({c}) <> double('Infinity')" for c in ("x", "y")]
    rows = rows.where("x is not null and y is not null and " + " and ".join(inside))
    points = rows.groupBy(F.col("f").cast("int").alias("f"), F.expr("x + 0.0D").alias("x"), F.expr("y + 0.0D").alias("y"))
    points = checkpointed(points.agg(F.count(F.lit(1)).alias("w")))
    spreads = rows.groupBy(F.col("f").cast("int").alias("f")).agg(F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    ratio = F.col("sx") / F.col("sy")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(ratio)) - 9)
    spreads = spreads.select("f", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.rint(ratio / unit) * unit).otherwise(1.0).alias("ratio"))
    # a row for each feature
    return points.join(F.broadcast(spreads), "f").select("f", "x", (F.col("y") * F.col("ratio")).alias("y"), "w")


def radii(points: DataFrame, k: int, strips: int | None = None) -> DataFrame:
    """f, x, y, w, n, k and r of each of the distinct ``points`` of a feature with two points or more."""
    sizes = points.groupBy("f").agg(F.sum("w").alias("n")).where("n > 1")
    points = points.join(F.broadcast(sizes.select("f")), "f", "left_semi")
    if strips is None:
        total = points.count()
        strips = max(1, math.ceil(math.sqrt(total / (2 * LEAF))), math.ceil(total / STRIP))
    dealt = checkpointed(points.repartitionByRange(strips, "f", "x", "y").withColumn("part", F.spark_partition_id()))
    sides = [F.min("x"), F.min("y"), F.max("x"), F.max("y")]
    boxes: dict[int, list[tuple]] = {}
    for row in dealt.groupBy("f", "part").agg(*sides).collect():
        boxes.setdefault(row[0], []).append(tuple(row[1:]))
    arrays = {}
    for f, some in boxes.items():
        table = np.array(some, dtype=np.float64)
        arrays[f] = (table[:, 0].astype(np.int64), table[:, 1:3], table[:, 3:5])
    own = checkpointed(dealt.groupBy("f", "part").applyInPandas(_own(arrays, k), FOUND))
    asks = own.where("hit >= 0").select("f", F.col("hit").alias("part"), "x", "y", "w", "bound")
    answers = asks.groupBy("f", "part").cogroup(dealt.groupBy("f", "part")).applyInPandas(_asked(k), ANSWER)
    found = own.where("hit < 0").select("f", "x", "y", "w", "d", "dw").unionByName(answers)
    near = F.array_sort(F.collect_list(F.struct("d", F.col("dw").alias("w"))))  # at most k of each strip that was asked
    met = found.groupBy("f", "x", "y").agg(F.first("w").alias("w"), near.alias("near")).join(F.broadcast(sizes), "f")
    met = met.withColumn("k", F.least(F.lit(k).cast("long"), F.col("n") - 1))
    return met.select("f", "x", "y", "w", "n", "k", reach("k", "w", "near").alias("r"))


def plane_information(rows: DataFrame, k: int = NEIGHBOURS, strips: int | None = None) -> DataFrame:
    """(f, mi): mutual information in nats of x and y for each f; ``rows`` has f (int), x and y (double)."""
    found = checkpointed(radii(_points(rows), k, strips))
    point = F.struct("x", "y").alias("c")
    both = [F.struct((F.col("f") * 2 + i).alias("f"), F.col(side).alias("x")) for i, side in enumerate(("x", "y"))]
    sides = found.select(F.explode(F.array(*both)).alias("e"), point, "w", F.col("n").alias("n_c"), "k", "r")
    counted = within(sides.select("e.f", "c", "e.x", "w", "n_c", "k", "r"))
    w, x_side = F.col("w").cast("double"), F.col("f") % 2 == 0
    terms = F.sum(w * (F.when(x_side, digamma(F.col("k"))).otherwise(0.0) - digamma(F.col("m"))))
    total = F.max("n_c")
    counted = counted.groupBy(F.expr("cast(floor(f / 2) as int)").alias("f"))
    return counted.agg(F.greatest(F.lit(0.0), digamma(total) + terms / total).alias("mi"))
