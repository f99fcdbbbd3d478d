"""The built-in checks under their registered names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framevitals.operators import labels, leakage, predictive, quality, statistics
from framevitals.operators.profile import Profile
from framevitals.plans.registry import register_check

STANDARD = (
    "data_quality",
    "imbalance",
    "ml_readiness",
    "data_leakage",
    "outliers",
    "suggestions",
    "stats",
    "predictive_power",
)


@register_check("data_quality")
def _quality(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return quality.quality(profile)


@register_check("imbalance")
def _imbalance(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return labels.imbalance(df, target)


@register_check("ml_readiness")
def _readiness(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    found = context.get("imbalance")
    flagged = bool(found.first()["is_imbalanced"]) if found is not None and "is_imbalanced" in found.columns else False
    return quality.ml_readiness(profile, flagged)


@register_check("data_leakage")
def _leakage(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return leakage.leakage(df, target)


@register_check("outliers")
def _outliers(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return statistics.outliers(df)


@register_check("suggestions")
def _suggestions(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return quality.suggestions(profile)


@register_check("stats")
def _stats(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return statistics.stats_numeric(df)


@register_check("predictive_power")
def _predictive(df: DataFrame, target: str | None, profile: Profile, context: dict) -> DataFrame:
    return predictive.predictive_power(df, target)
