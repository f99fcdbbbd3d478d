"""Thresholds that turn numbers into verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, weights and labels that results must agree on.
MISSING_DANGER_PCT = 50.0
CARDINALITY_HIGH = 0.5
SCORE_OK, SCORE_WARN = 80.0, 50.0
ERROR_BAD, ERROR_WARN = 10.0, 5.0
PERFECT_R, HIGH_R = 0.9999, 0.90
EXTREME_SHARE, HIGH_SHARE, MODERATE_SHARE = 0.95, 0.80, 0.60
SIGNAL_LEAKAGE, SIGNAL_STRONG, SIGNAL_MODERATE = 0.5, 0.1, 0.01
HEALTH_MISSING_WEIGHT, HEALTH_OUTLIER_WEIGHT = 0.7, 0.3
QUALITY_WEIGHTS = {"missing": 40.0, "duplicate": 25.0, "constant": 20.0}
READINESS_PENALTIES = {
    "low_sample_size": 20,
    "insufficient_features": 15,
    "high_missing_values": 20,
    "duplicate_rows": 10,
    "target_imbalance": 10,
}
READINESS_MIN_ROWS, READINESS_MIN_COLUMNS, READINESS_MAX_MISSING = 100, 3, 0.10
READINESS_BASE_WEIGHT, READINESS_QUALITY_WEIGHT = 0.6, 0.4


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole as double, 0 when the whole is 0."""
    value = F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
    return value if digits is None else F.round(value, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    value = part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.round(F.coalesce(value, F.lit(0.0)), digits)


def missing_severity(pct: Column) -> Column:
    return F.when(pct > MISSING_DANGER_PCT, "DANGER").otherwise("WARNING")


def cardinality_band(unique: Column, rows: Column) -> Column:
    return F.when(ratio(unique, rows) > CARDINALITY_HIGH, "High").otherwise("Optimal")


def score_band(score: Column) -> Column:
    return F.when(score >= SCORE_OK, "ok").when(score >= SCORE_WARN, "warn").otherwise("bad")


def error_band(pct: Column) -> Column:
    return F.when(pct > ERROR_BAD, "bad").when(pct > ERROR_WARN, "warn").otherwise("ok")


def correlation_band(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= PERFECT_R, "perfect").when(size >= HIGH_R, "high")


def imbalance_severity(majority: Column) -> Column:
    return (
        F.when(majority >= EXTREME_SHARE, "EXTREME")
        .when(majority >= HIGH_SHARE, "HIGH")
        .when(majority >= MODERATE_SHARE, "MODERATE")
        .when(majority.isNotNull(), "LOW")
    )


def signal_band(score: Column, leaking: Column) -> Column:
    return (
        F.when(leaking | (score > SIGNAL_LEAKAGE), "Leakage")
        .when(score > SIGNAL_STRONG, "Strong")
        .when(score > SIGNAL_MODERATE, "Moderate")
        .otherwise("Noise")
    )


def health_score(missing_pct: Column, outlier_pct: Column) -> Column:
    penalty = missing_pct * HEALTH_MISSING_WEIGHT + outlier_pct * HEALTH_OUTLIER_WEIGHT
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - penalty, 0)).cast("bigint")


def magnitude(value: Column) -> Column:
    """1500 -> 1.5k, 2000000 -> 2.0M; smaller numbers unchanged."""
    return (
        F.when(value >= 1_000_000, F.format_string("%.1fM", value / F.lit(1_000_000.0)))
        .when(value >= 1_000, F.format_string("%.1fk", value / F.lit(1_000.0)))
        .otherwise(value.cast("string"))
    )
