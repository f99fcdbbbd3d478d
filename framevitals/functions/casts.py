"""Lenient casts: what does not parse becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C

# Accepted spellings and formats.
TRUE_TEXT = ("true", "1")
FALSE_TEXT = ("false", "0")
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)
MORE_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dd-MMM-yyyy",
    "dd MMM yyyy",
    "MMM dd, yyyy",
    "MMMM dd, yyyy",
    "dd MMMM yyyy",
)
ZONED_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mmXXX")
#: The same digits may mean month and day or day and month: a column decides between the two by its values.
EITHER_FIRST = (
    ("MM/dd/yyyy", "dd/MM/yyyy"),
    ("MM-dd-yyyy", "dd-MM-yyyy"),
    ("MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss"),
    ("MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm"),
)
WHOLE_TOLERANCE = 1e-8
NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"
WHOLE = r"^[+-]?\d+$"


def to_float(value: Column, family: str) -> Column:
    if family == C.STRING:
        text = F.trim(value)  # the cast alone would take 1D and 2f for numbers
        number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    elif family == C.DATETIME:
        number = C.micros(value).cast("double")
    else:
        number = value.cast("double")
    return F.when(~F.isnan(number), number)


def to_int(value: Column, family: str) -> Column:
    """Rounded half to even, like the nullable integers of data frames; whole numbers in text stay exact."""
    if family == C.INTEGER:
        return value.cast("bigint")
    rounded = F.rint(to_float(value, family)).try_cast("bigint")
    if family != C.STRING:
        return rounded
    text = F.trim(value)
    return F.coalesce(F.when(text.rlike(WHOLE), text.try_cast("bigint")), rounded)


def to_bool(value: Column, family: str) -> Column:
    """Only true/false/1/0 count; Spark's own cast would also take yes, t, y and no."""
    if family == C.BOOLEAN:
        return value
    if family in (C.INTEGER, C.FRACTIONAL):
        return F.when(value == 1, True).when(value == 0, False)
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*TRUE_TEXT), True).when(text.isin(*FALSE_TEXT), False)


def to_datetime(value: Column, family: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    if family == C.DATETIME:
        return value.cast("timestamp_ntz")
    if family != C.STRING:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*[_parsed(F.trim(value), f) for f in formats])


def _parsed(text: Column, pattern: str) -> Column:
    """The time of a text; one with a zone is brought to UTC."""
    time = F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
    return F.convert_timezone(None, F.lit("UTC"), time) if pattern.endswith("X") else time


def vote_formats(df: DataFrame, column: str) -> tuple[str, ...]:
    """The date formats that occur in a text column, most specific first, from one aggregate over all its values.

    Where month and day may change places, the reading that more values allow wins for the whole column (month first, if
    equally many), so that one column is never read both ways.
    """
    text = F.trim(C.ref(column))
    plain = [*DATE_FORMATS[:-1], *MORE_DATE_FORMATS, *ZONED_FORMATS]
    every = [*plain, *(f for pair in EITHER_FIRST for f in pair)]
    row = df.agg(*[F.count(F.try_to_timestamp(text, F.lit(f))).alias(f"n{i}") for i, f in enumerate(every)]).first()
    votes = {f: row[f"n{i}"] for i, f in enumerate(every)}
    winners = [month if votes[month] >= votes[day] else day for month, day in EITHER_FIRST]
    return tuple(f for f in [*plain, *winners] if votes[f]) or DATE_FORMATS


def is_number(value: Column) -> Column:
    return to_float(value, C.STRING).isNotNull()


def is_whole(number: Column) -> Column:
    return F.abs(number - F.round(number)) <= WHOLE_TOLERANCE


def infer_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    formats: Sequence[str] = DATE_FORMATS,
    flags: Sequence[str] = (),
) -> dict[str, str]:
    """column -> 'int', 'float', 'date' or 'string', judged on every value in one aggregate.

    Text columns with nothing but ``flags`` are 'bool'.
    """
    names = list(columns) if columns is not None else [c for c, f in C.families(df).items() if f != C.NESTED]
    C.require(df, names)
    df = C.nan_to_null(df)
    families = C.families(df)
    out: dict[str, str] = {}
    batch = 40
    for start in range(0, len(names), batch):
        part = names[start : start + batch]
        aggs = []
        for i, c in enumerate(part):
            v, fam = C.ref(c), families[c]
            number = to_float(v, fam)
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.count(number).alias(f"num{i}"),
                F.count_if(is_whole(number)).alias(f"whole{i}"),
                F.count(to_datetime(v, fam, formats)).alias(f"date{i}"),
                F.count_if(v.cast("string").isin(*flags) if flags else F.lit(False)).alias(f"flag{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, c in enumerate(part):
            n, fam = row[f"n{i}"], families[c]
            if n == 0:
                out[c] = "string"
            elif row[f"flag{i}"] == n and fam == C.STRING:
                out[c] = "bool"
            elif fam == C.DATETIME or (fam == C.STRING and row[f"num{i}"] < n and row[f"date{i}"] == n):
                out[c] = "date"
            elif row[f"num{i}"] == n:
                out[c] = "int" if row[f"whole{i}"] == n else "float"
            else:
                out[c] = "string"
    return out
