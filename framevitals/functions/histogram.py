"""Value histograms: one narrow grouped row per distinct value of each column.

All columns of a frame are counted in one scan and one shuffle. Every cell is routed to
one of three typed slots (bigint, double, string), so numbers are never printed as text,
and rows stay narrow however many columns there are. The partial aggregate collapses
repeated values before the shuffle, so a value that fills a third of a column costs one
row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framevitals.functions import columns as C

CID, INT, DBL, TXT, HITS = "cid", "int_value", "dbl_value", "txt_value", "n"
LONG_TEXT = 64
BATCH = 100


def _slots(field: T.StructField, digest_long: bool) -> tuple[Column, Column, Column]:
    value = C.ref(field.name)
    none_i, none_d, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    fam = C.family_of(field.dataType)
    if fam in (C.INTEGER, C.BOOLEAN):
        return value.cast("bigint"), none_d, none_s
    if fam == C.DATETIME:
        return C.micros(value), none_d, none_s
    if fam == C.FRACTIONAL and not isinstance(field.dataType, T.DecimalType):
        return none_i, value.cast("double"), none_s
    if fam == C.FRACTIONAL:
        return none_i, none_d, value.cast("string")
    if fam == C.STRING:
        return none_i, none_d, text_key(value) if digest_long else value
    return F.when(value.isNotNull(), F.lit(1).cast("bigint")), none_d, none_s


def text_key(value: Column) -> Column:
    """Grouping key for text: the text itself, or its SHA-256 when it is long.

    Equal keys mean equal texts, and a 100 KB document shuffles as 64 bytes.
    """
    return F.when(F.length(value) > LONG_TEXT, F.concat(F.lit("\u0001"), F.sha2(value, 256))).otherwise(value)


def value_histogram(df: DataFrame, columns: Sequence[str] | None = None, digest_long: bool = True) -> DataFrame:
    """(cid, int_value, dbl_value, txt_value, n): ``cid`` is the position in ``columns``.

    A NULL cell has all three slots NULL. Nested columns only count present and missing.
    """
    names = list(df.columns if columns is None else columns)
    long = None
    for start in range(0, len(names), BATCH):  # very wide frames: a few narrow scans, still one shuffle
        batch = names[start : start + BATCH]
        cells = [x for i, c in enumerate(batch) for x in (F.lit(start + i), *_slots(df.schema[c], digest_long))]
        part = df.select(F.stack(F.lit(len(batch)), *cells).alias(CID, INT, DBL, TXT))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(CID, INT, DBL, TXT).agg(F.count(F.lit(1)).alias(HITS))


def is_missing() -> Column:
    return F.col(INT).isNull() & F.col(DBL).isNull() & F.col(TXT).isNull()


def row_keys(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Grouping keys that are equal exactly when the rows are equal; maps are left out."""
    keys = []
    for f in df.schema.fields:
        if (columns is not None and f.name not in columns) or isinstance(f.dataType, T.MapType):
            continue
        value = C.ref(f.name)
        keys.append((text_key(value) if isinstance(f.dataType, T.StringType) else value).alias(f.name))
    return keys
