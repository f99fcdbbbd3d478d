"""Target leakage: suspicious correlations, duplicate columns and the overall risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import columns as C
from framevitals.operators.correlation import corr_target

HIGH_COUNT_LIMIT = 2
BATCH = 40


def _comparable(df: DataFrame, name: str) -> tuple[str, Column]:
    """(class, value): columns of one class can be equal; numbers and booleans share one."""
    family = C.families(df)[name]
    if family == C.BOOLEAN:
        return "number", C.ref(name).cast("int")
    if family in (C.INTEGER, C.FRACTIONAL):
        return "number", C.ref(name)
    if family == C.STRING:
        return "text", C.ref(name)
    return df.schema[name].dataType.simpleString(), C.ref(name)


def duplicate_columns(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """column, duplicate_of: columns equal to an earlier one on every row (NULL equals NULL).

    A one-row aggregate fingerprints every column; only columns with the same fingerprint
    are compared value by value, in a second aggregate. Rows are never transposed or moved.
    """
    df = C.nan_to_null(df)
    names = [c for c in df.columns if c not in set(exclude)]
    kinds = {c: _comparable(df, c) for c in names if not df.schema[c].dataType.simpleString().startswith("map<")}
    groups: dict[tuple, list[str]] = {}
    usable = list(kinds)
    for start in range(0, len(usable), BATCH):
        batch = usable[start : start + BATCH]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(batch):
            kind, value = kinds[c]
            hashed = F.xxhash64(value.cast("double") + F.lit(0.0) if kind == "number" else value)
            aggs.append(F.count_if(value.isNull()).alias(f"gaps{i}"))
            aggs.append(F.bit_xor(hashed).alias(f"mix{i}"))
            aggs.append(F.sum(hashed.bitwiseAND(F.lit(0xFFFFF))).alias(f"sum{i}"))
        row = df.agg(*aggs).first()
        for i, c in enumerate(batch):
            kind = "empty" if row[f"gaps{i}"] == row["rows"] else kinds[c][0]
            groups.setdefault((kind, row[f"gaps{i}"], row[f"mix{i}"], row[f"sum{i}"]), []).append(c)
            if row["rows"] == 0:
                return C.small_frame(df.sparkSession, _DUP_SCHEMA, [])

    twin: dict[str, str] = {}
    open_groups = []
    for (kind, *_), members in groups.items():
        if kind == "empty":
            twin.update({later: members[0] for later in members[1:]})
        elif len(members) > 1:
            open_groups.append(members)
    while open_groups:  # each round compares with the first of a group; the unequal ones go on without it
        pairs = [(members[0], later) for members in open_groups for later in members[1:]]
        equal: set[tuple[str, str]] = set()
        for start in range(0, len(pairs), BATCH):
            batch = pairs[start : start + BATCH]
            checks = [F.bool_and(kinds[a][1].eqNullSafe(kinds[b][1])).alias(f"p{i}") for i, (a, b) in enumerate(batch)]
            row = df.agg(*checks).first()
            equal.update(pair for i, pair in enumerate(batch) if row[f"p{i}"])
        twin.update({later: first for first, later in equal})
        rest = [[m for m in members[1:] if (members[0], m) not in equal] for members in open_groups]
        open_groups = [members for members in rest if len(members) > 1]
    return C.small_frame(df.sparkSession, _DUP_SCHEMA, [(b, twin[b]) for b in names if b in twin])


_DUP_SCHEMA = "column string, duplicate_of string"


def leakage(df: DataFrame, target: str | None) -> DataFrame:
    """One row: risk (HIGH, LOW, NONE), the three lists of columns, numeric feature count, details."""
    schema = (
        "risk string, perfect_predictors array<string>, high_correlation array<string>, "
        "duplicate_columns array<string>, numeric_features int, details string"
    )
    spark = df.sparkSession
    if not target or target.strip() not in df.columns:
        return C.small_frame(spark, schema, [("NONE", [], [], [], 0, "no valid target")])
    name = target.strip()
    found = corr_target(df, name).where("band is not null").collect()  # at most one row per column
    order = {c: i for i, c in enumerate(df.columns)}
    perfect = sorted((r["feature"] for r in found if r["band"] == "perfect"), key=order.get)
    high = sorted((r["feature"] for r in found if r["band"] == "high"), key=order.get)
    twins = [r["column"] for r in duplicate_columns(df, exclude=[name]).collect()]
    lists = C.small_frame(
        spark,
        "perfect_predictors array<string>, high_correlation array<string>, duplicate_columns array<string>",
        [(perfect, high, twins)],
    )
    n_high = F.size("high_correlation")
    risk = (
        F.when((F.size("perfect_predictors") > 0) | (n_high > HIGH_COUNT_LIMIT) | (F.size("duplicate_columns") > 0), "HIGH")
        .when(n_high > 0, "LOW")
        .otherwise("NONE")
    )
    return lists.select(
        risk.alias("risk"),
        "*",
        F.lit(len(C.numeric_columns(df, exclude=[name]))).alias("numeric_features"),
        F.lit(None).cast("string").alias("details"),
    )


def leakage_features(df: DataFrame, target: str) -> DataFrame:
    """feature, r, band of the perfect predictors and high correlations only."""
    return corr_target(df, target).where(F.col("band").isNotNull())
