"""Tables with injected defects. Each text runs unchanged in Spark SQL and in the checking engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framevitals.functions import columns as C

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

ORDERS_DIRTY = """
  with o as (
    select o_orderkey, o_custkey, o_orderstatus, o_orderdate,
           case when o_orderkey % 17 = 0 then null else o_totalprice end as o_totalprice,
           case when o_orderkey % 23 = 0 then '  ' else o_orderpriority end as o_orderpriority,
           case when o_orderkey % 3 <> 0 then o_totalprice / 2 end as sparse_val,
           'v1' as const_col
    from {orders})
  select * from o union all select * from o where o_orderkey % 50 = 0
"""
LINE_LEAK = """
  select l_orderkey, l_linenumber, l_quantity, l_extendedprice,
         l_extendedprice * 2 as price_x2,
         l_extendedprice * (1 - l_discount) as net,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) as charged,
         cast(7 as double) as const_num
  from {lineitem}
"""
DOCS_DUP = "select doc_id, lang, source, n_chars, cast(length(text) as bigint) as text_len from {documents}"
TEXT_NUMBERS = """
  select event_id,
         case when event_id % 11 = 0 then 'n/a' else cast(event_id % 97 as varchar(10)) end as int_text,
         cast(event_id % 89 as varchar(10)) as whole_text,
         case when event_id % 4 = 0 then ' TRUE ' when event_id % 4 = 1 then '0'
              when event_id % 4 = 2 then 'yes' else 'false' end as bool_text,
         case when event_id % 13 = 0 then 'bad'
              else concat('2024-01-', lpad(cast(event_id % 28 + 1 as varchar(2)), 2, '0')) end as date_text
  from {events}
"""
EVENTS_GAP = """
  select event_id, user_id, event_type, ts, case when event_id % 7 = 0 then null else value end as value
  from {events}
"""
EVENTS_IP = """
  select event_id, user_id, ts, event_type,
         concat(case when event_id % 2 = 0 then '10.0.' else '81.2.' end,
                cast(event_id % 256 as varchar(3)), '.', cast(user_id % 256 as varchar(3))) as ip
  from {events}
"""
LABELED = """
  select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  from {documents} d join {labels} l on d.doc_id = l.doc_id
"""
RANGES = """
  select cast(1359085568 as bigint) as lo, cast(1359118335 as bigint) as hi, 'AA' as country
  union all select cast(1359118336 as bigint), cast(1359126527 as bigint), 'BB'
"""  # 81.2.0.0 - 81.2.127.255 and 81.2.128.0 - 81.2.159.255

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def named(text: str) -> str:
    """The fixture as SQL for the checking engine."""
    return text.format(**{t: t for t in TABLES})


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: bigint, rounded double, text timestamps."""
    out = []
    for f in df.schema.fields:
        v, fam = C.ref(f.name), C.family_of(f.dataType)
        if fam == C.INTEGER:
            v = v.cast("bigint")
        elif fam == C.FRACTIONAL:
            v = F.round(v.cast("double"), digits)
        elif fam == C.DATETIME:
            v = F.date_format(v, "yyyy-MM-dd HH:mm:ss")
        out.append(v.alias(f.name))
    return df.select(*out)


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(coalesce(cast({part} as double) * 100.0 / nullif({whole}, 0), 0.0), {digits})"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


DIRTY_TYPES = {
    "o_orderkey": ("bigint", "integer"),
    "o_custkey": ("bigint", "integer"),
    "o_orderstatus": ("string", "string"),
    "o_orderdate": ("timestamp_ntz", "datetime"),
    "o_totalprice": ("double", "fractional"),
    "o_orderpriority": ("string", "string"),
    "sparse_val": ("double", "fractional"),
    "const_col": ("string", "string"),
}
EVENT_TYPES = {
    "event_id": ("bigint", "integer"),
    "ts": ("timestamp_ntz", "datetime"),
    "user_id": ("bigint", "integer"),
    "event_type": ("string", "string"),
    "value": ("double", "fractional"),
    "props": ("string", "string"),
}


def report_sql(source: str, types: dict[str, tuple[str, str]]) -> str:
    """Column report of ``source`` (a SELECT) for the checking engine."""
    parts = [
        f"select {i}::bigint as position, '{c}' as \"column\", '{t}' as type, '{fam}' as family, "
        f"count(*) as rows, count(*) - count({c}) as missing, "
        f"{pct(f'(count(*) - count({c}))', 'count(*)')} as missing_pct, "
        f"count(distinct {c}) as n_unique from src"
        for i, (c, (t, fam)) in enumerate(types.items())
    ]
    return f"with src as ({source}) " + union(parts)


def quality_parts(source: str, columns: list[str]) -> str:
    """CTE chain ending in one row q(rows, cols, m, d, c) of unrounded ratios."""
    n = len(columns)
    gaps = " + ".join(f"(count(*) - count({c}))" for c in columns)
    const = " + ".join(f"(case when count(distinct {c}) <= 1 then 1 else 0 end)" for c in columns)
    return (
        f"src as ({source}), "
        f"dd as (select count(*) as kept from (select distinct * from src)), "
        f"q as (select count(*) as rows, {n}::bigint as cols, "
        f"({gaps})::double / (count(*) * {n}) as m, "
        f"(count(*) - (select kept from dd))::double / count(*) as d, "
        f"({const})::double / {n} as c from src)"
    )
