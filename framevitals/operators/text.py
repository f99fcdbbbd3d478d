"""Text and encoding fixes for string columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C
from framevitals.operators.statistics import per_column

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
SPACES = r"[ \t\n\r]+"
REPLACEMENT = "�"


def clean_text(value: Column) -> Column:
    """Drop control characters, collapse runs of white space to one blank, trim."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, CONTROL, ""), SPACES, " "))


def text_clean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING)
    C.require(df, names)
    return df.withColumns({c: clean_text(C.ref(c)) for c in names}) if names else df


def text_issues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, present, padded, spaced, control, replacement: rows that each fix would touch."""
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING)
    if not names:
        ddl = "column string, present bigint, padded bigint, spaced bigint, control bigint, replacement bigint"
        return C.small_frame(df.sparkSession, ddl, [])

    def metrics(c: str):
        v = C.ref(c)
        return {
            "present": F.count(v),
            "padded": F.count_if(v != F.trim(v)),
            "spaced": F.count_if(v.rlike(r"[ \t\n\r]{2,}")),
            "control": F.count_if(v.rlike(CONTROL)),
            "replacement": F.count_if(F.contains(v, F.lit(REPLACEMENT))),
        }

    return per_column(df, names, metrics, ("present", "padded", "spaced", "control", "replacement"))
