"""Validation checks: ranges, formats, schema, types in text, missing patterns, category and unit variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framevitals.functions import bands, casts
from framevitals.functions import columns as C
from framevitals.functions import histogram as H
from framevitals.operators.lookup import attach
from framevitals.sources.scratch import checkpointed
from framevitals.operators.statistics import per_column

UNIT_PATTERN = r"^\s*[-+]?[0-9][0-9.,]*\s*([A-Za-z%°µ]+)\s*$"


def range_check(df: DataFrame, rules: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """column, lower, upper, below, above, violations, ratio for (min, max) rules, ends included."""
    C.require(df, list(rules))
    df = C.nan_to_null(df)

    def metrics(c: str):
        low, high = rules[c]
        v = C.as_double(c)
        below = F.count_if(v < F.lit(low).cast("double"))
        above = F.count_if(v > F.lit(high).cast("double"))
        return {
            "below": below,
            "above": above,
            "violations": below + above,
            "ratio": bands.ratio(below + above, F.count(F.lit(1)), 4),
        }

    def known(c: str):
        return dict(zip(("lower", "upper"), (F.lit(x).cast("double") for x in rules[c])))

    return per_column(df, list(rules), metrics, ("lower", "upper", "below", "above", "violations", "ratio"), known)


def format_check(
    df: DataFrame, patterns: dict[str, str] | None = None, dates: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """column, kind, present, invalid, ratio: text against a pattern, or against date formats."""
    patterns, dates = patterns or {}, dates or {}
    C.require(df, [*patterns, *dates])
    names = [*patterns, *dates]

    def metrics(c: str):
        v = C.ref(c).cast("string")
        good = v.rlike(patterns[c]) if c in patterns else casts.to_datetime(v, C.STRING, dates[c]).isNotNull()
        present, invalid = F.count(v), F.count_if(v.isNotNull() & ~good)
        return {"present": present, "invalid": invalid, "ratio": bands.ratio(invalid, present, 4)}

    def known(c: str):
        return {"kind": F.lit("pattern" if c in patterns else "date")}

    return per_column(df, names, metrics, ("kind", "present", "invalid", "ratio"), known)


def schema_check(df: DataFrame, expected: T.StructType | str) -> DataFrame:
    """column, expected, actual, status ('ok', 'missing', 'extra', 'type'), present, misfits.

    ``misfits`` are values of a wrongly typed column that cannot become the expected type.
    """
    wanted = expected if isinstance(expected, T.StructType) else T.StructType.fromDDL(expected)
    want = {f.name: f.dataType.simpleString() for f in wanted.fields}
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*want, *[c for c in have if c not in want]]
    data = C.nan_to_null(df)
    aggs = []
    for i, c in enumerate(names):
        if c not in have:
            aggs += [F.first(F.lit(None).cast("bigint")).alias(f"p{i}"), F.first(F.lit(None).cast("bigint")).alias(f"m{i}")]
            continue
        v = C.ref(c)
        lost = v.try_cast(want[c]).isNull() if want.get(c, have[c]) != have[c] else F.lit(False)
        aggs += [F.count(v).alias(f"p{i}"), F.count_if(v.isNotNull() & lost).alias(f"m{i}")]
    cells = []
    for i, c in enumerate(names):
        a, b = want.get(c), have.get(c)
        status = "missing" if b is None else "extra" if a is None else "ok" if a == b else "type"
        texts = [F.lit(x).cast("string") for x in (c, a, b, status)]
        cells += [*texts, F.col(f"p{i}"), F.col(f"m{i}")]
    return data.agg(*aggs).select(
        F.stack(F.lit(len(names)), *cells).alias("column", "expected", "actual", "status", "present", "misfits")
    )


def type_consistency(
    df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = casts.DATE_FORMATS
) -> DataFrame:
    """column, present, numbers, dates, words, main, mismatches of text columns, by how values parse."""
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING)
    if not names:
        ddl = "column string, present bigint, numbers bigint, dates bigint, words bigint, main string, mismatches bigint"
        return C.small_frame(df.sparkSession, ddl, [])

    def metrics(c: str):
        v = C.ref(c)
        number = casts.is_number(v)
        date = ~number & casts.to_datetime(v, C.STRING, formats).isNotNull()
        return {"present": F.count(v), "numbers": F.count_if(number), "dates": F.count_if(date)}

    found = per_column(df, names, metrics, ("present", "numbers", "dates"))
    words = F.col("present") - F.col("numbers") - F.col("dates")
    top = F.greatest("numbers", "dates", "words")
    main = F.when(F.col("words") == top, "text").when(F.col("numbers") == top, "number").otherwise("date")
    return found.withColumn("words", words).select(
        "*", main.alias("main"), (F.col("present") - top).alias("mismatches")
    )


def missing_patterns(df: DataFrame) -> DataFrame:
    """pattern ('1' where a column is missing, in column order), columns, n, share.

    Grouping by a short bit string collapses to one row per pattern in each input partition.
    """
    df = C.nan_to_null(df)
    bits = F.concat(*[F.when(C.ref(c).isNull(), "1").otherwise("0") for c in df.columns])
    names = F.array(*[F.when(C.ref(c).isNull(), F.lit(c)) for c in df.columns])
    grouped = df.groupBy(bits.alias("pattern"), F.array_join(F.array_compact(names), ",").alias("columns")).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = bands.ratio(F.col("n"), F.lit(df.count()), 4)
    return grouped.select("pattern", "columns", "n", share.alias("share"))


def category_variants(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, normal, spellings, n, preferred: texts equal but for case and outer blanks.

    ``preferred`` is the most frequent spelling (smallest on a tie).
    """
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING)
    if not names:
        ddl = "column string, normal string, spellings bigint, n bigint, preferred string"
        return C.small_frame(df.sparkSession, ddl, [])
    counts = H.value_histogram(df.select(*[C.ref(c) for c in names]), digest_long=False).where(F.col(H.TXT).isNotNull())
    best = F.min(F.struct((-F.col(H.HITS)).alias("less"), F.col(H.TXT).alias("text")))
    return (
        counts.groupBy(H.CID, F.lower(F.trim(F.col(H.TXT))).alias("normal"))
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum(H.HITS).alias("n"), best.alias("best"))
        .where("spellings > 1")
        .select(
            F.get(F.array(*[F.lit(c) for c in names]), F.col(H.CID)).alias("column"),
            "normal",
            "spellings",
            "n",
            F.col("best.text").alias("preferred"),
        )
    )


def normalize_categories(df: DataFrame, column: str) -> DataFrame:
    """Replace every spelling variant by the preferred one; rows without variants are untouched."""
    C.require(df, column)
    variants = category_variants(df, [column])
    entries = checkpointed(variants.select(F.col("normal").alias("value"), F.col("preferred").alias("found"), "n"))
    fixed = attach(df, F.lower(F.trim(C.ref(column))), entries, "__preferred")
    value = F.coalesce("__preferred", C.ref(column))
    return fixed.select(*[value.alias(c) if c == column else C.ref(c) for c in df.columns])


def unit_mix(df: DataFrame, columns: Sequence[str] | None = None, pattern: str = UNIT_PATTERN) -> DataFrame:
    """column, unit ('' without one), n, share of the measured values in text columns."""
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING)
    if not names:
        return C.small_frame(df.sparkSession, "column string, unit string, n bigint, share double", [])
    cells = []
    for i, c in enumerate(names):
        v = C.ref(c)
        unit = F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1)).when(casts.is_number(v), F.lit(""))
        cells += [F.lit(i), unit]
    found = (
        df.select(F.stack(F.lit(len(names)), *cells).alias("cid", "unit"))
        .where("unit is not null")
        .groupBy("cid", "unit")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = found.groupBy("cid").agg(F.sum("n").alias("total"))  # one row per column
    return found.join(F.broadcast(totals), "cid").select(
        F.get(F.array(*[F.lit(c) for c in names]), F.col("cid")).alias("column"),
        "unit",
        "n",
        bands.ratio(F.col("n"), F.col("total"), 4).alias("share"),
    )
