"""Scores and rules over a profile: quality, ML readiness, suggestions, breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.operators.profile import Profile

# Limits and message texts that results must agree on.
MISSING_LIMIT = 0.3
SUGGEST_MISSING = "high missing (%.2f%%) → impute or drop"
SUGGEST_CONSTANT = "constant value detected → drop column"
SUGGEST_DATETIME = "potential datetime → extract temporal features"
DATETIME_WORDS = ("date", "time")


def _ratios(profile: Profile) -> DataFrame:
    """One row: rows, cols and the missing, duplicate and constant ratios, unrounded."""
    rows, cols = F.lit(profile.rows).cast("bigint"), F.lit(len(profile.columns)).cast("bigint")
    totals = profile.frame().agg(
        F.coalesce(F.sum("missing"), F.lit(0)).alias("empty"),
        F.count_if(F.col("n_unique") <= 1).alias("constant"),
    )
    return totals.select(
        rows.alias("rows"),
        cols.alias("cols"),
        bands.ratio(F.col("empty"), rows * cols).alias("missing"),
        bands.ratio(F.lit(profile.duplicates), rows).alias("duplicate"),
        bands.ratio(F.col("constant"), cols).alias("constant"),
    )


def _quality_score(rows: Column, cols: Column) -> Column:
    penalty = sum((F.col(part) * weight for part, weight in bands.QUALITY_WEIGHTS.items()), F.lit(0.0))
    score = F.round(F.greatest(F.lit(100.0) - penalty, F.lit(0.0)), 2)
    return F.when((rows == 0) | (cols == 0), F.lit(0.0)).otherwise(score)


def quality(profile: Profile) -> DataFrame:
    """One row: score (0-100) and the three ratios behind it (4 digits)."""
    return _ratios(profile).select(
        _quality_score(F.col("rows"), F.col("cols")).alias("score"),
        *[F.round(part, 4).alias(f"{part}_ratio") for part in bands.QUALITY_WEIGHTS],
        "rows",
        "cols",
    )


def ml_readiness(profile: Profile, is_imbalanced: bool = False, use_quality: bool = True) -> DataFrame:
    """One row: value (0-100, truncated), base score, penalties as array of (name, points)."""
    hits = {
        "low_sample_size": F.col("rows") < bands.READINESS_MIN_ROWS,
        "insufficient_features": F.col("cols") < bands.READINESS_MIN_COLUMNS,
        "high_missing_values": F.col("missing") > bands.READINESS_MAX_MISSING,
        "duplicate_rows": F.col("duplicate") > 0,
        "target_imbalance": F.lit(bool(is_imbalanced)),
    }
    penalties = F.array_compact(
        F.array(
            *[
                F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(bands.READINESS_PENALTIES[name]).alias("points")))
                for name, hit in hits.items()
            ]
        )
    )
    lost = F.aggregate("penalties", F.lit(0), lambda acc, p: acc + p["points"])
    blended = bands.READINESS_BASE_WEIGHT * F.col("base") + bands.READINESS_QUALITY_WEIGHT * F.col("score")
    final = blended if use_quality else F.col("base").cast("double")
    return (
        _ratios(profile)
        .select("*", penalties.alias("penalties"), _quality_score(F.col("rows"), F.col("cols")).alias("score"))
        .withColumn("base", F.lit(100) - lost)
        .select(
            F.floor(F.greatest(F.round(final, 9), F.lit(0.0))).cast("int").alias("value"),
            F.col("base").cast("int").alias("base"),
            "penalties",
            F.array_join(
                F.transform("penalties", lambda p: F.concat(p["name"], F.lit(":"), p["points"].cast("string"))), ","
            ).alias("penalty_list"),
            "rows",
            "cols",
            F.round("missing", 4).alias("missing_ratio"),
            F.lit(use_quality).alias("used_data_quality"),
        )
    )


def suggestions(profile: Profile, missing_limit: float = MISSING_LIMIT) -> DataFrame:
    """One row per finding: position, column, rule, suggestion."""
    share = bands.ratio(F.col("missing"), F.col("rows"))
    name = F.lower("column")
    dated = F.lit(False)
    for word in DATETIME_WORDS:
        dated = dated | F.contains(name, F.lit(word))
    rules = [
        ("missing", share > missing_limit, F.format_string(SUGGEST_MISSING, share * 100.0)),
        ("constant", F.col("n_unique") <= 1, F.lit(SUGGEST_CONSTANT)),
        ("datetime", dated, F.lit(SUGGEST_DATETIME)),
    ]
    fired = [
        F.when(hit, F.struct(F.lit(rule).alias("rule"), F.concat(F.col("column"), F.lit(": "), text).alias("suggestion")))
        for rule, hit, text in rules
    ]
    return profile.frame().select("position", "column", F.inline(F.array_compact(F.array(*fired))))


def score_breakdown(profile: Profile, consistency: float) -> DataFrame:
    """One row: completeness, uniqueness, consistency (0-1) and their mean.

    ``consistency`` is the share of text cells that agree with the main type of their column
    (see ``validation.type_consistency``).
    """
    whole = 1.0 - F.col("missing")
    unique = 1.0 - F.col("duplicate")
    return _ratios(profile).select(
        F.round(whole, 4).alias("completeness"),
        F.round(unique, 4).alias("uniqueness"),
        F.round(F.lit(float(consistency)), 4).alias("consistency"),
        F.round((whole + unique + F.lit(float(consistency))) / 3, 4).alias("overall_score"),
    )
