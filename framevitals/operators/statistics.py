"""Descriptive statistics, skewness and outliers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions import columns as C
from framevitals.functions import histogram as H
from framevitals.functions.moments import adjusted_skewness
from framevitals.functions.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)
BATCH = 40


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    metrics: Callable[[str], dict[str, Column]],
    schema: Sequence[str],
    known: Callable[[str], dict[str, Column]] = lambda c: {},
) -> DataFrame:
    """One-row aggregates of many columns, turned into one row per column.

    ``metrics`` are aggregates, ``known`` are constants that only join the result. Wide
    frames are aggregated in batches so that generated code stays compilable.
    """
    out = None
    for start in range(0, len(columns), BATCH):
        batch = list(columns)[start : start + BATCH]
        aggs, cells = [], []
        for i, c in enumerate(batch):
            cells.append(F.lit(c))
            made, fixed = metrics(c), known(c)
            for m in schema:
                if m not in fixed:
                    aggs.append(made[m].alias(f"{m}_{i}"))
                cells.append(fixed[m] if m in fixed else F.col(f"{m}_{i}"))
        part = df.agg(*aggs).select(F.stack(F.lit(len(batch)), *cells).alias("column", *schema))
        out = part if out is None else out.unionByName(part)
    return out


def quartiles_of(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[float | None]]:
    """Column -> quartiles, for handing to several of the checks below."""
    df = C.nan_to_null(df)
    return exact_quantiles(df, list(columns) if columns is not None else C.numeric_columns(df), QUARTILES)


def stats_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    quartiles: dict[str, list[float | None]] | None = None,
) -> DataFrame:
    """column, type, count, mean, std, min, q25, q50, q75, max of every numeric column."""
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    types = dict(df.dtypes)
    if not names:
        return C.small_frame(df.sparkSession, _NUMERIC_SCHEMA, [])
    quartiles = exact_quantiles(df, names, QUARTILES) if quartiles is None else quartiles

    def metrics(c: str) -> dict[str, Column]:
        v = C.as_double(c)
        return {"count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}

    def known(c: str) -> dict[str, Column]:
        quarters = {q: F.lit(x).cast("double") for q, x in zip(("q25", "q50", "q75"), quartiles[c])}
        return {"type": F.lit(types[c]), **quarters}

    schema = ("type", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    return per_column(df, names, metrics, schema, known)


_NUMERIC_SCHEMA = (
    "column string, type string, count bigint, mean double, std double, min double, "
    "q25 double, q50 double, q75 double, max double"
)


def stats_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, n_unique, top, freq of text and boolean columns; ties go to the smallest value."""
    names = list(columns) if columns is not None else C.columns_in(df, C.STRING, C.BOOLEAN)
    if not names:
        return C.small_frame(
            df.sparkSession, "column string, count bigint, n_unique bigint, top string, freq bigint", []
        )
    text = df.select(*[C.ref(c).cast("string").alias(c) for c in names])
    best = F.min(F.struct((-F.col(H.HITS)).alias("less"), F.col(H.TXT).alias("top")))
    return (
        H.value_histogram(text, digest_long=False)
        .where(F.col(H.TXT).isNotNull())
        .groupBy(H.CID)
        .agg(F.sum(H.HITS).alias("count"), F.count(F.lit(1)).alias("n_unique"), best.alias("best"))
        .select(
            F.get(F.array(*[F.lit(c) for c in names]), F.col(H.CID)).alias("column"),
            "count",
            "n_unique",
            F.col("best.top").alias("top"),
            (-F.col("best.less")).alias("freq"),
        )
    )


def stats_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, count, mean, min, q25, q50, q75, max of dates and timestamps, as timestamps."""
    names = list(columns) if columns is not None else C.columns_in(df, C.DATETIME)
    metrics_names = ("mean", "min", "q25", "q50", "q75", "max")
    if not names:
        schema = "column string, count bigint, " + ", ".join(f"{m} timestamp" for m in metrics_names)
        return C.small_frame(df.sparkSession, schema, [])
    ticks = df.select(*[C.micros(C.ref(c)).alias(c) for c in names])
    quartiles = exact_quantiles(ticks, names, QUARTILES)

    def metrics(c: str) -> dict[str, Column]:
        v = C.ref(c)
        exact_mean = F.floor(F.avg(v.cast("decimal(20,0)"))).cast("bigint")
        made = {"mean": exact_mean, "min": F.min(v), "max": F.max(v)}
        return {"count": F.count(v), **{m: F.timestamp_micros(x) for m, x in made.items()}}

    def known(c: str) -> dict[str, Column]:
        whole = [F.lit(None if x is None else int(x)).cast("bigint") for x in quartiles[c]]
        return {q: F.timestamp_micros(x) for q, x in zip(("q25", "q50", "q75"), whole)}

    return per_column(ticks, names, metrics, ("count", *metrics_names), known)


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, skewness (bias-adjusted; NULL below three values)."""
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    if not names:
        return C.small_frame(df.sparkSession, "column string, skewness double", [])
    return per_column(df, names, lambda c: {"skewness": adjusted_skewness(C.as_double(c))}, ("skewness",))


def outliers(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    quartiles: dict[str, list[float | None]] | None = None,
) -> DataFrame:
    """column, q1, q3, lower, upper, outliers, ratio by Tukey's fences.

    Columns without spread (equal quartiles) have no row. The ratio is over all rows. Bounds
    are two numbers per column, so the counting pass gets them as constants.
    """
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    found = exact_quantiles(df, names, (0.25, 0.75)) if quartiles is None else quartiles
    quartiles = {c: (found[c][0], found[c][-1]) for c in names}
    quartiles = {c: q for c, q in quartiles.items() if None not in q and q[1] > q[0]}
    schema = ("q1", "q3", "lower", "upper", "outliers", "ratio")
    if not quartiles:
        ddl = "column string, q1 double, q3 double, lower double, upper double, outliers bigint, ratio double"
        return C.small_frame(df.sparkSession, ddl, [])

    def metrics(c: str) -> dict[str, Column]:
        q1, q3 = quartiles[c]
        reach = 1.5 * (q3 - q1)
        lower, upper, v = F.lit(q1 - reach), F.lit(q3 + reach), C.as_double(c)
        hits = F.count_if((v < lower) | (v > upper))
        return {"outliers": hits, "ratio": bands.ratio(hits, F.count(F.lit(1)), 4)}

    def known(c: str) -> dict[str, Column]:
        q1, q3 = quartiles[c]
        reach = 1.5 * (q3 - q1)
        return {"q1": F.lit(q1), "q3": F.lit(q3), "lower": F.lit(q1 - reach), "upper": F.lit(q3 + reach)}

    return per_column(df, list(quartiles), metrics, schema, known)


def outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 3.0) -> DataFrame:
    """column, mean, std, outliers, ratio: values more than ``limit`` deviations off the mean."""
    df = C.nan_to_null(df)
    names = list(columns) if columns is not None else C.numeric_columns(df)
    moments = {}
    if names:
        first = per_column(
            df, names, lambda c: {"mean": F.avg(C.as_double(c)), "std": F.stddev_samp(C.as_double(c))}, ("mean", "std")
        )
        moments = {r["column"]: (r["mean"], r["std"]) for r in first.collect() if r["std"]}  # one row per column
    if not moments:
        ddl = "column string, mean double, std double, outliers bigint, ratio double"
        return C.small_frame(df.sparkSession, ddl, [])

    def metrics(c: str) -> dict[str, Column]:
        mean, std = moments[c]
        hits = F.count_if(F.abs((C.as_double(c) - F.lit(mean)) / F.lit(std)) > limit)
        return {"outliers": hits, "ratio": bands.ratio(hits, F.count(F.lit(1)), 4)}

    def known(c: str) -> dict[str, Column]:
        return {"mean": F.lit(moments[c][0]), "std": F.lit(moments[c][1])}

    return per_column(df, list(moments), metrics, ("mean", "std", "outliers", "ratio"), known)
