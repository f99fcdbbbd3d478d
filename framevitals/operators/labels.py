"""Target checks: class distribution, imbalance, rare classes, conflicting labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions import columns as C
from framevitals.functions import histogram as H

MAX_CLASSES = 1000


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    name = C.check_target(df, target)
    return C.nan_to_null(df.select(C.ref(name).alias("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """label, n, share (4 digits), share_pct (1 digit), largest class first; NULL is a class, and every class has a row."""
    counts = _class_counts(df, target)
    return (
        counts.select("label", "n", counts.agg(F.sum("n")).scalar().alias("total"))
        .select(
            F.col("label").cast("string").alias("label"),
            "n",
            bands.ratio(F.col("n"), F.col("total"), 4).alias("share"),
            bands.percent(F.col("n"), F.col("total"), 1).alias("share_pct"),
        )
        .orderBy(F.desc("n"), F.asc_nulls_first("label"))
    )


def imbalance(df: DataFrame, target: str, max_classes: int = MAX_CLASSES) -> DataFrame:
    """One row: target, rows, num_classes, majority/minority ratio, severity, flag, missing ratio.

    Above ``max_classes`` classes ``details`` says so; the numbers hold all the same.
    """
    stats = _class_counts(df, target).agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.max("n").alias("biggest"),
        F.min("n").alias("smallest"),
        F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("gaps"),
    )
    usable = F.col("rows") > 0
    majority = F.col("biggest").cast("double") / F.nullif(F.col("rows").cast("double"), F.lit(0.0))
    severity = F.when(usable, bands.imbalance_severity(majority))
    return stats.select(
        F.lit(target.strip()).alias("target"),
        F.col("rows").cast("bigint").alias("rows"),
        F.when(usable, F.col("classes")).alias("num_classes"),
        F.when(usable, F.round(majority, 4)).alias("majority_ratio"),
        F.when(usable, bands.ratio(F.col("smallest"), F.col("rows"), 4)).alias("minority_ratio"),
        severity.alias("severity"),
        F.coalesce(severity.isin("HIGH", "EXTREME"), F.lit(False)).alias("is_imbalanced"),
        F.when(usable, bands.ratio(F.col("gaps"), F.col("rows"), 4)).alias("missing_ratio"),
        F.when(F.col("rows") == 0, "target column is empty")
        .when(F.col("classes") > max_classes, "target has too many distinct values")
        .alias("details"),
    )


def rare_classes(df: DataFrame, target: str, below: float = 0.05) -> DataFrame:
    """label, n, share of the classes whose share of all rows is under ``below``."""
    counts = _class_counts(df, target)
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = F.col("n").cast("double") / F.lit(float(max(total, 1)))
    return counts.where(share < below).select(
        F.col("label").cast("string").alias("label"), "n", F.round(share, 4).alias("share")
    )


def label_conflicts(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """Feature combinations that carry more than one label: the features, n_labels, n_rows.

    Rows collapse to (features, label) counts before the second grouping, so a
    combination that fills a third of the rows is a handful of pre-aggregated ones.
    """
    name = C.check_target(df, target)
    names = list(features) if features is not None else [c for c in df.columns if c != name]
    C.require(df, names)
    keys = [C.ref(c) for c in names]
    pairs = df.where(C.ref(name).isNotNull()).groupBy(*keys, C.ref(name)).agg(F.count(F.lit(1)).alias(H.HITS))
    return (
        pairs.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_labels"), F.sum(H.HITS).alias("n_rows"))
        .where("n_labels > 1")
    )
