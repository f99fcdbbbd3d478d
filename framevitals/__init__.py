"""Dataset health checks and cleaning on Spark DataFrames."""

from framevitals.operators.labels import class_distribution, imbalance
from framevitals.operators.leakage import leakage
from framevitals.operators.predictive import predictive_power
from framevitals.operators.profile import Profile, column_report, duplicates, profile, summary
from framevitals.operators.quality import ml_readiness, quality, suggestions
from framevitals.operators.statistics import outliers, stats_categorical, stats_datetime, stats_numeric
from framevitals.plans.checks import STANDARD
from framevitals.plans.recipe import Cleaned, clean
from framevitals.plans.registry import register_check, register_step, run_checks
from framevitals.plans.report import full_report, quick_report
from framevitals.sources.csv import preview, read_csv, validate_source, write_csv
from framevitals.sources.reports import load_report, save_report

__all__ = [
    "STANDARD",
    "Cleaned",
    "Profile",
    "class_distribution",
    "clean",
    "column_report",
    "duplicates",
    "full_report",
    "imbalance",
    "leakage",
    "load_report",
    "ml_readiness",
    "outliers",
    "predictive_power",
    "preview",
    "profile",
    "quality",
    "quick_report",
    "read_csv",
    "register_check",
    "register_step",
    "run_checks",
    "save_report",
    "stats_categorical",
    "stats_datetime",
    "stats_numeric",
    "suggestions",
    "summary",
    "validate_source",
    "write_csv",
]
