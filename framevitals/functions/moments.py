"""Aggregate expressions for skewness and pairwise-complete correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_skewness(value: Column) -> Column:
    """Bias-adjusted sample skewness; NULL below three values or without spread."""
    n = F.count(value).cast("double")
    return F.when(n >= 3, F.skewness(value) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both sides are present.

    ``corr`` raises on a constant side under ANSI rules; the regression sums give the same
    number and NULL where r is undefined.
    """
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0))
