"""Column families, safe column references and missing-value normalisation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = "integer"
FRACTIONAL = "fractional"
STRING = "string"
BOOLEAN = "boolean"
DATETIME = "datetime"
NESTED = "nested"

BLANK_PATTERN = r"(?U)^\s*$"


def quoted(name: str) -> str:
    """Back-quote a column name so that dots and spaces are safe in expressions."""
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def sql_text(text: str) -> str:
    """A SQL string literal for ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def family_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FRACTIONAL
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return STRING
    return NESTED


def families(df: DataFrame) -> dict[str, str]:
    """Column name -> family, in column order."""
    return {f.name: family_of(f.dataType) for f in df.schema.fields}


def columns_in(df: DataFrame, *wanted: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [c for c, fam in families(df).items() if fam in wanted and c not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Integer and fractional columns; booleans are not numeric features."""
    return columns_in(df, INTEGER, FRACTIONAL, exclude=exclude)


def require(df: DataFrame, columns: str | Sequence[str]) -> None:
    """Fail at plan time when a column does not exist."""
    names = [columns] if isinstance(columns, str) else list(columns)
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"column(s) not found: {', '.join(absent)}")


def check_target(df: DataFrame, target: str) -> str:
    """Strip a target name and make sure it is a column of ``df``."""
    name = (target or "").strip()
    if not name:
        raise ValueError("target must not be empty")
    require(df, name)
    return name


def as_double(name: str) -> Column:
    return ref(name).cast("double")


def total(parts: Sequence[Column]) -> Column:
    """Sum of many expressions as a balanced tree: a chain over a wide frame is too deep to plan."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0] if parts else F.lit(0)


def micros(column: Column) -> Column:
    """Microseconds since the epoch of a date or timestamp of either kind."""
    return F.unix_micros(column.cast("timestamp"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so turn it into NULL once, up front."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(ref(c)), ref(c)) for c in floats})


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty and whitespace-only text becomes NULL; other types are untouched."""
    text = [c for c in columns_in(df, STRING) if columns is None or c in columns]
    if not text:
        return df
    return df.withColumns({c: F.when(~ref(c).rlike(BLANK_PATTERN), ref(c)) for c in text})


def sanitize_names(df: DataFrame) -> DataFrame:
    """Keep letters, digits, underscores and blanks in column names.

    Two names that become equal (or a name that becomes empty) raise, instead of
    silently shadowing one column by another.
    """
    clean = ["".join(ch for ch in c if (ch.isascii() and ch.isalnum()) or ch in "_ ") for c in df.columns]
    if "" in clean or len({c.lower() for c in clean}) != len(clean):
        raise ValueError("sanitised column names collide or are empty")
    return df.toDF(*clean)


def small_frame(spark: SparkSession, schema: T.StructType | str, rows: Sequence[Sequence]) -> DataFrame:
    """A report-sized frame from values the driver already holds (never data rows)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    arrays = [pa.array([r[i] for r in rows], type=arrow.field(i).type) for i in range(len(struct.fields))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), struct)


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession
