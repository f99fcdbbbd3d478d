"""Row, missing, distinct and duplicate counts: the profile every other check starts from."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framevitals.functions import bands
from framevitals.functions import columns as C
from framevitals.functions import histogram as H


def column_report(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: position, type, family, rows, missing, missing_pct, n_unique.

    Exact distinct counts come from one histogram shuffle over all columns; with
    ``approx`` HyperLogLog replaces it and nothing but one row per task is shuffled.
    """
    df = C.nan_to_null(df)
    names, kinds = df.columns, list(C.families(df).values())
    if approx:
        counted = _approx_counts(df)
    else:
        missing = H.is_missing()
        counted = (
            H.value_histogram(df)
            .groupBy(H.CID)
            .agg(
                F.sum(H.HITS).alias("rows"),
                F.coalesce(F.sum(F.when(missing, F.col(H.HITS))), F.lit(0)).alias("missing"),
                F.count_if(~missing).alias("distinct_values"),
            )
        )
    cid = F.col(H.CID)

    def per_column(items):
        return F.get(F.array(*[F.lit(x) for x in items]), cid)

    family = per_column(kinds)
    return counted.select(
        cid.alias("position"),
        per_column(names).alias("column"),
        per_column([f.dataType.simpleString() for f in df.schema.fields]).alias("type"),
        family.alias("family"),
        F.col("rows").cast("bigint").alias("rows"),
        F.col("missing").cast("bigint").alias("missing"),
        bands.percent(F.col("missing"), F.col("rows")).alias("missing_pct"),
        F.when(family != C.NESTED, F.col("distinct_values")).cast("bigint").alias("n_unique"),
    )


def _approx_counts(df: DataFrame) -> DataFrame:
    parts = []
    for i, (name, family) in enumerate(C.families(df).items()):
        value = C.ref(name)
        distinct = F.lit(0).cast("bigint") if family == C.NESTED else F.approx_count_distinct(value, 0.01)
        parts.append((i, F.count_if(value.isNull()).alias(f"m{i}"), distinct.alias(f"u{i}")))
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[p for _, m, u in parts for p in (m, u)])
    cells = [c for i, _, _ in parts for c in (F.lit(i), F.col(f"m{i}"), F.col(f"u{i}"))]
    return wide.select("rows", F.stack(F.lit(len(parts)), *cells).alias(H.CID, "missing", "distinct_values"))


def duplicates(df: DataFrame) -> DataFrame:
    """rows, duplicates (rows beyond the first of each group of equal rows), duplicates_pct."""
    df = C.nan_to_null(df)
    grouped = df.groupBy(*H.row_keys(df)).agg(F.count(F.lit(1)).alias(H.HITS))
    totals = grouped.agg(F.coalesce(F.sum(H.HITS), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("kept"))
    extra = F.col("rows") - F.col("kept")
    return totals.select(
        F.col("rows").cast("bigint").alias("rows"),
        extra.cast("bigint").alias("duplicates"),
        bands.percent(extra, F.col("rows")).alias("duplicates_pct"),
    )


def summary(df: DataFrame, target: str | None = None, with_duplicates: bool = True) -> DataFrame:
    """The cheap first tier: rows, cols, missing_pct, duplicates, duplicates_pct, target.

    Rows, missing cells and duplicates come from one scan and one shuffle of row keys;
    without duplicates there is no shuffle at all.
    """
    df = C.nan_to_null(df)
    width = len(df.columns)
    empty_cells = C.total([C.ref(c).isNull().cast("bigint") for c in df.columns])
    if with_duplicates:
        marked = df.select(*H.row_keys(df), empty_cells.alias("__empty"))
        keys = [C.ref(c) for c in marked.columns if c != "__empty"]
        grouped = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum("__empty").alias("__empty"))
        rows, kept, empty = F.sum("__n"), F.count(F.lit(1)), F.sum("__empty")
        totals = grouped.agg(rows.alias("rows"), kept.alias("kept"), empty.alias("empty"))
        extra = F.coalesce(F.col("rows") - F.col("kept"), F.lit(0))
    else:
        totals = df.select(empty_cells.alias("__empty")).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("__empty").alias("empty")
        )
        extra = F.lit(None)
    rows = F.coalesce(F.col("rows"), F.lit(0))
    duplicates_pct = bands.percent(extra, rows) if with_duplicates else F.lit(None).cast("double")
    return totals.select(
        rows.cast("bigint").alias("rows"),
        F.lit(width).cast("bigint").alias("cols"),
        bands.percent(F.coalesce(F.col("empty"), F.lit(0)), rows * width).alias("missing_pct"),
        extra.cast("bigint").alias("duplicates"),
        duplicates_pct.alias("duplicates_pct"),
        F.lit(target).cast("string").alias("target"),
    )


@dataclass(frozen=True)
class ColumnInfo:
    position: int
    name: str
    type: str
    family: str
    missing: int
    n_unique: int | None


@dataclass(frozen=True)
class Profile:
    """What the checks need to know about a data set: one small entry per column."""

    spark: SparkSession
    rows: int
    duplicates: int
    columns: tuple[ColumnInfo, ...]

    def column(self, name: str) -> ColumnInfo:
        return next(c for c in self.columns if c.name == name)

    def frame(self) -> DataFrame:
        """One row per column, with the data-set totals repeated on each."""
        schema = (
            "position int, column string, type string, family string, rows bigint, cols bigint, "
            "missing bigint, n_unique bigint, duplicates bigint"
        )
        cells = [
            (c.position, c.name, c.type, c.family, self.rows, len(self.columns), c.missing, c.n_unique, self.duplicates)
            for c in self.columns
        ]
        return C.small_frame(self.spark, schema, cells).withColumn("any_duplicates", F.col("duplicates") > 0)


def profile(df: DataFrame, approx: bool = False) -> Profile:
    """Run the column and duplicate counts (two concurrent jobs) and keep the column-sized result."""
    with ThreadPoolExecutor(max_workers=1) as pool:
        counted = pool.submit(inheritable_thread_target(df.sparkSession)(lambda: duplicates(df).first()))
        got = {r["position"]: r for r in column_report(df, approx).collect()}  # one row per column
        total = counted.result()
    infos = []
    for i, (field, family) in enumerate(zip(df.schema.fields, C.families(df).values())):
        r = got.get(i)
        unique = r["n_unique"] if r else (None if family == C.NESTED else 0)
        infos.append(
            ColumnInfo(i, field.name, field.dataType.simpleString(), family, r["missing"] if r else 0, unique)
        )
    return Profile(df.sparkSession, total["rows"], total["duplicates"], tuple(infos))
