"""Tables for reading a report: joins and bands over column-sized results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions import columns as C


def column_families(columns: DataFrame) -> DataFrame:
    """column, type, kind: 'numeric' or 'categorical'."""
    numeric = F.col("family").isin(C.INTEGER, C.FRACTIONAL)
    return columns.select("column", "type", F.when(numeric, "numeric").otherwise("categorical").alias("kind"))


def health_table(columns: DataFrame) -> DataFrame:
    """Columns with missing values: column, type, missing_pct, status."""
    return columns.where("missing_pct > 0").select(
        "column", "type", "missing_pct", bands.missing_severity(F.col("missing_pct")).alias("status")
    )


def impute_candidates(columns: DataFrame) -> DataFrame:
    """Columns with at least one missing value, in column order."""
    return columns.where("missing > 0").select("position", "column", "missing", "missing_pct").orderBy("position")


def cardinality_table(columns: DataFrame) -> DataFrame:
    """Text columns: column, type, n_unique, cardinality band."""
    return columns.where(F.col("family") == C.STRING).select(
        "column", "type", "n_unique", bands.cardinality_band(F.col("n_unique"), F.col("rows")).alias("cardinality")
    )


def outlier_table(columns: DataFrame, outliers: DataFrame) -> DataFrame:
    """Columns with at least one outlier: column, type, outliers."""
    hits = outliers.where("outliers > 0").select("column", "outliers")
    return columns.select("column", "type").join(F.broadcast(hits), "column")  # one row per column


def signal_table(stats: DataFrame, power: DataFrame) -> DataFrame:
    """Numeric statistics with the predictive signal of each column; none counts as Noise."""
    known = power.select(F.col("feature").alias("column"), "score", "mi", "leakage_risk")
    joined = stats.where("mean is not null").join(F.broadcast(known), "column", "left")  # one row per feature
    score, risk = F.coalesce("score", F.lit(0.0)), F.coalesce("leakage_risk", F.lit(False))
    return joined.select(
        "column",
        F.round("mean", 2).alias("mean"),
        F.round("std", 2).alias("std"),
        F.round("q50", 2).alias("median"),
        score.alias("score"),
        F.coalesce("mi", F.lit(0.0)).alias("mi"),
        bands.signal_band(score, risk).alias("signal"),
    )


def column_health(columns: DataFrame, outliers: DataFrame) -> DataFrame:
    """column, missing_pct, outlier_pct, health (0-100)."""
    joined = columns.join(F.broadcast(outliers.select("column", "outliers")), "column", "left")
    hits = F.coalesce("outliers", F.lit(0))
    outlier_pct = bands.percent(hits, F.col("rows"))
    return joined.select(
        "column",
        "missing_pct",
        outlier_pct.alias("outlier_pct"),
        bands.health_score(F.col("missing_pct"), outlier_pct).alias("health"),
    )


def summary_status(summary: DataFrame, quality: DataFrame) -> DataFrame:
    """metric, value, status and short text of the headline numbers."""
    counts = summary.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), status.alias("status"))
                    for m, status in (
                        ("rows", F.lit("info")),
                        ("cols", F.lit("info")),
                        ("missing_pct", bands.error_band(F.col("missing_pct"))),
                        ("duplicates_pct", bands.error_band(F.col("duplicates_pct"))),
                    )
                ]
            )
        )
    )
    score = quality.select(
        F.lit("quality_score").alias("metric"), F.col("score").alias("value"), bands.score_band(F.col("score")).alias("status")
    )
    return counts.unionByName(score).withColumn("shown", bands.magnitude(F.col("value").cast("bigint")))


def score(quality: DataFrame, readiness: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: quality_score, ml_readiness, issues."""
    none_d, none_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    parts = (
        quality.select(F.col("score").alias("q"), none_i.alias("r"), F.lit(0).alias("issue"))
        .unionByName(readiness.select(none_d.alias("q"), F.col("value").alias("r"), F.lit(0).alias("issue")))
        .unionByName(suggestions.select(none_d.alias("q"), none_i.alias("r"), F.lit(1).alias("issue")))
    )
    return parts.agg(
        F.max("q").alias("quality_score"),
        F.max("r").alias("ml_readiness"),
        F.sum("issue").cast("bigint").alias("issues"),
    )


def with_declared_types(columns: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Column report with the declared type in place of the inferred one."""
    if not declared:
        return columns
    pairs = [F.lit(x) for kv in declared.items() for x in kv]
    return columns.withColumn("type", F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("column")), F.col("type")))
