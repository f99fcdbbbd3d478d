"""Cleaning operators: deduplicate, drop, impute, cast and encode."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import types as T

from framevitals.functions import casts
from framevitals.functions import columns as C
from framevitals.functions import histogram as H
from framevitals.functions.moments import adjusted_skewness
from framevitals.functions.ordered import in_parts
from framevitals.functions.quantiles import exact_quantiles
from framevitals.operators.lookup import SMALL_BYTES, attach
from framevitals.sources.scratch import checkpointed

SKEW_LIMIT = 1.0


# --- rows -------------------------------------------------------------------------------


def _orderable(df: DataFrame) -> bool:
    return not any("map<" in f.dataType.simpleString() for f in df.schema.fields)


def _one_per_key(df: DataFrame, subset: Sequence[str], order_by: Sequence[str], pick, only_single: bool) -> DataFrame:
    """Keep one row per key by aggregation: each input partition sends one row per key.

    A window would move every row of a hot key to one task; min/max of a struct combines
    map-side. The struct starts with the order columns, so it also breaks ties the same way
    on every run.
    """
    C.require(df, [*subset, *order_by])
    rest = [c for c in df.columns if c not in subset]
    payload = [C.ref(c).alias(f"o{i}") for i, c in enumerate(order_by)] + [
        C.ref(c).alias(f"r{i}") for i, c in enumerate(rest)
    ]
    kept = pick(F.struct(*payload)) if payload else F.first(F.lit(1))
    grouped = df.groupBy(*[C.ref(c) for c in subset]).agg(kept.alias("__kept"), F.count(F.lit(1)).alias("__n"))
    if only_single:
        grouped = grouped.where("__n = 1")
    spot = {c: F.col(f"__kept.r{i}") for i, c in enumerate(rest)}
    return grouped.select(*[spot[c].alias(c) if c in spot else C.ref(c) for c in df.columns])


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Drop repeated rows; with ``subset`` compare only those columns.

    ``keep`` is 'first', 'last' or False (drop every repeated row). Spark rows have no file
    order, so first and last are by ``order_by`` (then by the remaining columns). NaN is missing: it equals NULL and comes back
    as NULL. Maps are equal when their entries are, in any order; the map of a kept row is as it was.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    df = C.nan_to_null(df)
    names = list(subset) if subset else list(df.columns)
    maps = [c for c in names if isinstance(df.schema[c].dataType, T.MapType)]
    if maps:
        entries = {f"__entries{i}": F.array_sort(F.map_entries(C.ref(c))) for i, c in enumerate(maps)}
        keys = [*(c for c in names if c not in maps), *entries]
        return remove_duplicates(df.withColumns(entries), keys, keep, order_by).drop(*entries)
    if keep is False:
        return _one_per_key(df, names, (), F.min if _orderable(df) else F.first, only_single=True)
    if not subset:
        return df.dropDuplicates()
    if not _orderable(df):
        def pick(row: Column) -> Column:
            order = F.struct(*[C.ref(c) for c in order_by]) if order_by else F.lit(1)
            return F.min_by(row, order) if keep == "first" else F.max_by(row, order)
    else:
        pick = F.min if keep == "first" else F.max
    return _one_per_key(df, names, order_by, pick, only_single=False)


def dedupe_log(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """One row: rows, duplicates_removed, status, columns_affected; counted on keys only."""
    grouped = df.groupBy(*H.row_keys(df, subset)).agg(F.count(F.lit(1)).alias("__n"))
    totals = grouped.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("__n") == 1).alias("single"),
        F.count(F.lit(1)).alias("groups"),
    )
    removed = F.col("rows") - (F.col("single") if keep is False else F.col("groups"))
    return totals.select(
        F.col("rows").cast("bigint").alias("rows"),
        removed.cast("bigint").alias("duplicates_removed"),
        F.when(removed > 0, "optimized").otherwise("already_clean").alias("status"),
        F.lit(", ".join(subset) if subset else "all").alias("columns_affected"),
    )


# --- columns ----------------------------------------------------------------------------


def drop_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Drop the named columns; names that do not exist are ignored."""
    return df.drop(*[c for c in (columns or []) if c in df.columns])


def apply_schema(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Cast columns to declared types; values that do not fit become NULL, unknown names are ignored."""
    known = {c: t for c, t in declared.items() if c in df.columns}
    return df.withColumns({c: C.ref(c).try_cast(t) for c, t in known.items()}) if known else df


# --- imputation -------------------------------------------------------------------------


def impute_strategy(df: DataFrame, column: str) -> str:
    """'median' for skewed numbers, 'mean' for other numbers, 'mode' for the rest."""
    C.require(df, column)
    if C.families(df)[column] not in (C.INTEGER, C.FRACTIONAL):
        return "mode"
    skew = C.nan_to_null(df).agg(adjusted_skewness(C.as_double(column))).first()[0]
    return "median" if skew is not None and abs(skew) > SKEW_LIMIT else "mean"


def fill_value(df: DataFrame, column: str, strategy: str, constant: Any = 0) -> Any:
    """The single value that replaces NULLs in ``column``."""
    family = C.families(df)[column]
    value = C.ref(column)
    known = C.nan_to_null(df)
    if strategy == "constant":
        return constant
    if strategy == "mode":
        top = (
            known.where(value.isNotNull())
            .groupBy(value.alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("value"))
            .first()
        )
        if top is None:
            raise ValueError(f"no value to fill '{column}' with")
        return top["value"]
    if strategy not in ("mean", "median"):
        raise ValueError(f"unknown imputation method '{strategy}'")
    if family in (C.INTEGER, C.FRACTIONAL):
        if strategy == "mean":
            found = known.agg(F.avg(C.as_double(column))).first()[0]
        else:
            found = exact_quantiles(known, [column], (0.5,))[column][0]
    elif family == C.DATETIME:
        ticks = C.micros(value)
        if strategy == "mean":
            found = known.agg(F.floor(F.avg(ticks.cast("decimal(20,0)"))).cast("bigint")).first()[0]
        else:
            found = exact_quantiles(known, {column: ticks}, (0.5,))[column][0]
        found = None if found is None else int(found)
    else:
        raise ValueError(f"'{column}' is not numeric: no {strategy}")
    if found is None:
        raise ValueError(f"no value to fill '{column}' with")
    return found


def _constant(df: DataFrame, column: str, constant: Any) -> tuple[Column, bool]:
    """The constant as a literal of the column's type, tried when the step runs; an integer column with a fraction becomes double."""
    dtype = df.schema[column].dataType
    number = F.lit(constant).try_cast("double") if not isinstance(constant, bool) else F.lit(None).cast("double")
    tried = df.sparkSession.range(1).select(F.lit(constant).try_cast(dtype).alias("same"), number.alias("number")).first()
    if C.family_of(dtype) == C.INTEGER and tried["number"] is not None and tried["number"] != tried["same"]:
        return F.lit(tried["number"]), True
    if tried["same"] is None:
        raise ValueError(f"{constant!r} is no value for '{column}' ({dtype.simpleString()})")
    return F.lit(constant).cast(dtype), False


def impute(df: DataFrame, column: str, method: str = "auto", constant: Any = 0) -> tuple[DataFrame, dict[str, Any]]:
    """Fill the NULLs of one column; (frame, log). Without NULLs the frame is returned as it is.

    The fill value is one number or text read on the driver, so the fill itself is a plain
    projection that stays in the same stage as whatever comes next.
    """
    C.require(df, column)
    gaps = C.nan_to_null(df.select(C.ref(column))).agg(F.count_if(C.ref(column).isNull())).first()[0]
    if gaps == 0:
        return df, {"imputed": False, "reason": f"no missing values in '{column}'"}
    strategy = impute_strategy(df, column) if method == "auto" else method
    fill = fill_value(df, column, strategy, constant)
    dtype = df.schema[column].dataType
    family = C.family_of(dtype)
    widened = False
    if family == C.DATETIME and strategy in ("mean", "median"):
        literal = F.timestamp_micros(F.lit(fill)).cast(dtype)
    elif strategy == "constant":
        literal, widened = _constant(df, column, fill)
    elif strategy in ("mean", "median"):
        literal = F.lit(float(fill))
    else:
        literal = F.lit(fill).cast(dtype)
    known = C.nan_to_null(df)
    value = C.as_double(column) if widened or strategy in ("mean", "median") and family != C.DATETIME else C.ref(column)
    filled = known.withColumn(column, F.coalesce(value, literal))
    return filled, {"column": column, "strategy_used": strategy, "fill_value": str(fill), "nulls_fixed": gaps}


# --- casts ------------------------------------------------------------------------------

CAST_NAMES = {
    "date": "date",
    "datetime": "date",
    "float": "float",
    "numeric": "float",
    "int": "int",
    "integer": "int",
    "bool": "bool",
    "boolean": "bool",
    "encode": "encode",
}


def cast_column(
    df: DataFrame, column: str, method: str = "auto", formats: Sequence[str] | None = None
) -> tuple[DataFrame, dict[str, Any]]:
    """Cast one column to date, float, int or bool, label-encode it, or pick by its values; (frame, log).

    Text is read as dates by ``formats`` or, by default, by those that its values vote for. ``lost`` in the log counts the values that
    did not fit the new type and are NULL now, if there are any.
    """
    C.require(df, column)
    old = df.schema[column].dataType.simpleString()
    kind = casts.infer_types(df, [column], formats or casts.DATE_FORMATS)[column] if method == "auto" else CAST_NAMES.get(method)
    if kind is None or (kind == "string" and method == "auto"):
        # the guess 'string' is not a cast: it is reported, and the data stays as it is
        raise ValueError(f"unsupported target type: {method if kind is None else kind}")
    family, value, lost = C.families(df)[column], C.ref(column), 0
    if kind == "encode":
        out = label_encode(df, column)
    else:
        if formats is None:
            formats = casts.vote_formats(df, column) if kind == "date" and family == C.STRING else casts.DATE_FORMATS
        made = {
            "date": lambda: casts.to_datetime(value, family, formats),
            "float": lambda: casts.to_float(value, family),
            "int": lambda: casts.to_int(value, family),
            "bool": lambda: casts.to_bool(value, family),
            "string": lambda: value.cast("string"),
        }[kind]()
        if method != "auto" and family == C.STRING:  # the guess of 'auto' fits all values
            lost = C.nan_to_null(df.select(value)).agg(F.count_if(value.isNotNull() & made.isNull())).first()[0]
        out = df.withColumn(column, made)
    new = out.schema[column].dataType.simpleString()
    return out, {"column": column, "strategy_used": kind, "old_type": old, "new_type": new, "success": True} | ({"lost": lost} if lost else {})


def encoding(df: DataFrame, column: str) -> DataFrame:
    """(value, code, n) with codes 0.. in value order.

    Distinct values are dealt by ranges, numbered inside each part and shifted by the sizes of the parts before it, at every
    size alike; no task sees more values than its range holds.
    """
    C.require(df, column)
    values = (
        C.nan_to_null(df.select(C.ref(column).alias("value")))
        .where("value is not null")
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parts = in_parts(values, "value")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    shifts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    numbered = parts.withColumn("local", local).join(F.broadcast(shifts), "part")
    return numbered.select("value", (F.col("local") + F.col("shift")).cast("bigint").alias("code"), "n")


def label_encode(df: DataFrame, column: str, small: int = SMALL_BYTES) -> DataFrame:
    """Replace values by their rank (0..) among the sorted distinct values; NULL stays NULL."""
    entries = checkpointed(encoding(df, column)).select("value", F.col("code").alias("found"), "n")
    coded = attach(C.nan_to_null(df), C.ref(column), entries, "__code", small)
    return coded.select(*[F.col("__code").alias(c) if c == column else C.ref(c) for c in df.columns])
