"""Correlation with a target, between features, and multicollinearity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions import columns as C
from framevitals.functions.moments import pearson
from framevitals.operators.statistics import per_column
from framevitals.sources.scratch import checkpointed

PRODUCTS = "i int, j int, n long, mx double, my double, xy double, xx double, yy double"
#: Share of a column's variance that counts as none, and weight from which a column belongs to a dependency.
SINGULAR, INVOLVED = 1e-9, 1e-6


def corr_target(df: DataFrame, target: str) -> DataFrame:
    """feature, r, band ('perfect', 'high' or NULL) of numeric features against a numeric or boolean target."""
    df = C.nan_to_null(df)
    name = C.check_target(df, target)
    features = C.numeric_columns(df, exclude=[name])
    if C.families(df)[name] not in (C.INTEGER, C.FRACTIONAL, C.BOOLEAN) or not features:
        return C.small_frame(df.sparkSession, "feature string, r double, band string", [])
    y = C.ref(name).cast("int" if C.families(df)[name] == C.BOOLEAN else "double").cast("double")
    rows = per_column(df, features, lambda c: {"r": pearson(C.as_double(c), y)}, ("r",))
    return rows.select(F.col("column").alias("feature"), "r", bands.correlation_band(F.col("r")).alias("band"))


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """x, y, r for every pair of numeric columns (x before y), pairwise complete, from one scan of the data.

    Each task keeps the cross products of its rows as matrices, missing values masked out, and gives one row for each pair at its
    end; these combine in Spark. r is NULL where a side has one value, or no rows have both sides, and NaN where infinities meet.
    """
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    if len(names) < 2:
        return C.small_frame(df.sparkSession, "x string, y string, r double", [])
    parts = df.select(*[C.as_double(c).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(_cross_products, PRODUCTS)
    parts = checkpointed(parts)
    # means from a base that the parts share, so that equal values leave exactly 0
    pair = Window.partitionBy("i", "j")
    dx, dy, n = F.col("mx") - F.min("mx").over(pair), F.col("my") - F.min("my").over(pair), F.col("n")
    sums = parts.select("i", "j", "n", "xy", "xx", "yy", dx.alias("dx"), dy.alias("dy")).groupBy("i", "j")
    total, sx, sy = F.sum("n"), F.sum(n * F.col("dx")), F.sum(n * F.col("dy"))
    joint = F.sum(F.col("xy") + n * F.col("dx") * F.col("dy")) - sx * sy / total
    spread_x = F.sum(F.col("xx") + n * F.col("dx") * F.col("dx")) - sx * sx / total
    spread_y = F.sum(F.col("yy") + n * F.col("dy") * F.col("dy")) - sy * sy / total
    spread = F.sqrt(spread_x) * F.sqrt(spread_y)
    found = sums.agg((joint / F.nullif(spread, F.lit(0.0))).alias("r"))
    last = len(names) - 1
    pairs = df.sparkSession.range(last).select(F.col("id").cast("int").alias("i"))
    pairs = pairs.select("i", F.explode(F.sequence(F.col("i") + 1, F.lit(last))).alias("j"))
    label = F.array(*[F.lit(c) for c in names])
    return pairs.join(found, ["i", "j"], "left").select(F.get(label, F.col("i")).alias("x"), F.get(label, F.col("j")).alias("y"), "r")


def _cross_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of columns: rows with both sides, their means, and the centred products, of all batches of a task."""
    base = total = None
    for batch in batches:
        values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if not len(values):
            continue
        there = ~np.isnan(values)
        # the first value of a column that the task meets: its distance to itself is 0
        first = np.where(there.any(axis=0), values[there.argmax(axis=0), np.arange(values.shape[1])], np.nan)
        base = first if base is None else np.where(np.isnan(base), first, base)
        with np.errstate(invalid="ignore", over="ignore"):
            moved = np.where(there, values - np.where(np.isnan(base), 0.0, base), 0.0)
            mask = there.astype(np.float64)
            sums = np.stack((mask.T @ mask, moved.T @ mask, moved.T @ moved, (moved * moved).T @ mask))
            total = sums if total is None else total + sums
    if total is None:
        return
    i, j = np.triu_indices(len(base), 1)
    n, x, xy, xx = total
    keep = n[i, j] > 0
    i, j = i[keep], j[keep]
    with np.errstate(invalid="ignore", over="ignore"):
        count, sx, sy = n[i, j], x[i, j], x[j, i]
        columns = [
            count.astype(np.int64), base[i] + sx / count, base[j] + sy / count,
            xy[i, j] - sx * sy / count, xx[i, j] - sx * sx / count, xx[j, i] - sy * sy / count,
        ]
    arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, columns)]
    yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "n", "mx", "my", "xy", "xx", "yy"])


def collinear_pairs(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.9) -> DataFrame:
    """The pairs of ``corr_matrix`` with |r| above ``limit``."""
    return corr_matrix(df, columns).where(F.abs("r") > limit)


def variance_inflation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, vif, dependent_on: a row for every column, from the correlation matrix.

    ``vif`` is infinite (NULL here) for the columns of an exact linear dependency, and ``dependent_on`` then names the others of it;
    all remaining columns keep their finite value. A column with one value has no correlation: NULL and 'constant'.
    Columns enter in pivoted order, the one with most variance left first, so the dependency is found whatever the order
    given. Spark computes the matrix; only its (columns x columns) numbers reach the driver.
    """
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    spread = df.agg(*[F.stddev_samp(C.as_double(c)).alias(f"s{i}") for i, c in enumerate(names)]).first() if names else ()
    usable = [c for i, c in enumerate(names) if spread[i]]
    matrix = np.eye(len(usable))
    place = {c: i for i, c in enumerate(usable)}
    for row in corr_matrix(df, usable).collect() if len(usable) > 1 else []:
        i, j = place[row["x"]], place[row["y"]]
        matrix[i, j] = matrix[j, i] = row["r"] if row["r"] is not None else 0.0
    free, sets = _pivots(matrix)
    inverse = np.linalg.inv(matrix[np.ix_(free, free)]) if free else np.eye(0)
    vif: dict[str, float | None] = {usable[j]: float(inverse[k, k]) for k, j in enumerate(free)}
    tied: dict[str, set[str]] = {}
    for group in sets:
        for j in group:
            vif[usable[j]] = None
            tied.setdefault(usable[j], set()).update(usable[i] for i in group if i != j)
    rows = []
    for c in names:
        others = ",".join(x for x in names if x in tied.get(c, ())) or None
        rows.append((c, vif.get(c), others) if c in place else (c, None, "constant"))
    return C.small_frame(df.sparkSession, "column string, vif double, dependent_on string", rows)


def _pivots(matrix: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Pivoted Cholesky: the independent columns, and for each other one the set of columns that are exactly dependent with it."""
    n = len(matrix)
    left, factors, free = np.diag(matrix).copy(), np.zeros((n, n)), []
    for k in range(n):
        j = int(np.argmax(np.round(left, 12)))  # the first among equals
        if left[j] <= SINGULAR:
            break
        factors[:, k] = (matrix[:, j] - factors[:, :k] @ factors[j, :k]) / np.sqrt(left[j])
        left = left - factors[:, k] ** 2
        free.append(j)
        left[free] = -1.0
    sets = []
    for j in sorted(set(range(n)) - set(free)):
        weights = np.linalg.solve(matrix[np.ix_(free, free)], matrix[free, j])
        sets.append(sorted([j, *(i for i, w in zip(free, weights) if abs(w) > INVOLVED)]))
    return sorted(free), sets
