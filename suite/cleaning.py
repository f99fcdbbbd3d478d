"""Cleaning operators and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framevitals.functions import casts
from framevitals.functions.columns import blank_to_null, sanitize_names, small_frame
from framevitals.operators import cleaning
from framevitals.operators.profile import column_report
from framevitals.plans.recipe import clean
from framevitals.plans.views import with_declared_types
from suite.fixtures import (
    DIRTY_TYPES, EVENTS_GAP, ORDERS_DIRTY, TEXT_NUMBERS, fixture, named, plain, query, report_sql, stamp, table,
)

DIRTY = named(ORDERS_DIRTY)
NUMBERS = named(TEXT_NUMBERS)
SHOWN = {
    "o_orderkey": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "o_orderstatus",
    "o_orderdate": stamp("o_orderdate"),
    "o_totalprice": "round(o_totalprice, 4)",
    "o_orderpriority": "o_orderpriority",
    "sparse_val": "round(sparse_val, 4)",
    "const_col": "const_col",
}
BLANKED = f"""select * replace (case when regexp_matches(o_orderpriority, '^\\s*$') then null else o_orderpriority end
    as o_orderpriority) from ({DIRTY})"""


def shown(source: str, **changed: str) -> str:
    return "select " + ", ".join(f"{changed.get(c, e)} as {c}" for c, e in SHOWN.items()) + f" from ({source})"


def dirty(spark, sf_dir):
    return fixture(spark, sf_dir, ORDERS_DIRTY)


@query("blank_to_null", shown(BLANKED))
def _(spark, sf_dir):
    return plain(blank_to_null(dirty(spark, sf_dir)), 4)


@query("drop_columns", f"select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from ({DIRTY})")
def _(spark, sf_dir):
    return cleaning.drop_columns(
        dirty(spark, sf_dir), ["const_col", "sparse_val", "o_totalprice", "o_orderdate", "no_such_column"]
    )


@query("dedupe", shown(f"select distinct * from ({DIRTY})"))
def _(spark, sf_dir):
    return plain(cleaning.remove_duplicates(dirty(spark, sf_dir)), 4)


def ranked(direction: str) -> str:
    return f"""select * exclude (rn) from (select *, row_number() over (partition by o_custkey, o_orderstatus
    order by o_orderdate {direction}, o_orderkey {direction}) as rn from ({DIRTY})) where rn = 1"""


@query("dedupe_first", shown(ranked("asc")))
def _(spark, sf_dir):
    keys = ["o_custkey", "o_orderstatus"]
    return plain(cleaning.remove_duplicates(dirty(spark, sf_dir), keys, "first", ["o_orderdate", "o_orderkey"]), 4)


@query("dedupe_last", shown(ranked("desc")))
def _(spark, sf_dir):
    keys = ["o_custkey", "o_orderstatus"]
    return plain(cleaning.remove_duplicates(dirty(spark, sf_dir), keys, "last", ["o_orderdate", "o_orderkey"]), 4)


@query(
    "dedupe_none",
    shown(f"""select * exclude (k) from (select *, count(*) over (partition by o_custkey, o_orderstatus) as k
    from ({DIRTY})) where k = 1"""),
)
def _(spark, sf_dir):
    return plain(cleaning.remove_duplicates(dirty(spark, sf_dir), ["o_custkey", "o_orderstatus"], False), 4)


@query(
    "dedupe_log",
    f"""with src as ({DIRTY}), d as (select count(*) - (select count(*) from (select distinct * from src)) as n from src)
    select (select count(*) from src) as rows, n as duplicates_removed,
    case when n > 0 then 'optimized' else 'already_clean' end as status, 'all' as columns_affected from d""",
)
def _(spark, sf_dir):
    return plain(cleaning.dedupe_log(dirty(spark, sf_dir)))


# --- imputation -------------------------------------------------------------------------


@query(
    "impute_mean",
    shown(DIRTY, o_totalprice=f"round(coalesce(o_totalprice, (select avg(o_totalprice) from ({DIRTY}))), 4)"),
)
def _(spark, sf_dir):
    return plain(cleaning.impute(dirty(spark, sf_dir), "o_totalprice", "mean")[0], 4)


@query(
    "impute_median",
    shown(DIRTY, sparse_val=f"round(coalesce(sparse_val, (select quantile_cont(sparse_val, 0.5) from ({DIRTY}))), 4)"),
)
def _(spark, sf_dir):
    return plain(cleaning.impute(dirty(spark, sf_dir), "sparse_val", "median")[0], 4)


@query(
    "impute_mode",
    shown(
        BLANKED,
        o_orderpriority=f"""coalesce(o_orderpriority, (select o_orderpriority from ({BLANKED})
        where o_orderpriority is not null group by o_orderpriority order by count(*) desc, o_orderpriority limit 1))""",
    ),
)
def _(spark, sf_dir):
    return plain(cleaning.impute(blank_to_null(dirty(spark, sf_dir)), "o_orderpriority", "mode")[0], 4)


@query("impute_constant_widened", "select event_id, coalesce(case when event_id % 5 > 0 then event_id end, 1.5)::double as n from events")
def _(spark, sf_dir):
    """A fraction in an integer column: the column becomes double, nothing is cut off."""
    df = table(spark, sf_dir, "events").selectExpr("event_id", "if(event_id % 5 > 0, event_id, null) as n")
    return plain(cleaning.impute(df, "n", "constant", 1.5)[0], 4)


@query("impute_constant", shown(DIRTY, sparse_val="round(coalesce(sparse_val, -1), 4)"))
def _(spark, sf_dir):
    return plain(cleaning.impute(dirty(spark, sf_dir), "sparse_val", "constant", -1)[0], 4)


GAP = named(EVENTS_GAP)


@query(
    "impute_auto",
    f"""select event_id, user_id, event_type, round(coalesce(value, (select case when abs(skewness(value)) > 1
    then quantile_cont(value, 0.5) else avg(value) end from ({GAP}))), 4) as value from ({GAP})""",
)
def _(spark, sf_dir):
    return plain(cleaning.impute(fixture(spark, sf_dir, EVENTS_GAP), "value", "auto")[0].drop("ts"), 4)


# --- casts ------------------------------------------------------------------------------


def numbers(spark, sf_dir):
    return fixture(spark, sf_dir, TEXT_NUMBERS)


@query("cast_int", f"select event_id, try_cast(round_even(try_cast(int_text as double), 0) as bigint) as int_text from ({NUMBERS})")
def _(spark, sf_dir):
    return cleaning.cast_column(numbers(spark, sf_dir).select("event_id", "int_text"), "int_text", "int")[0]


@query("cast_float", f"select event_id, try_cast(int_text as double) as int_text from ({NUMBERS})")
def _(spark, sf_dir):
    return cleaning.cast_column(numbers(spark, sf_dir).select("event_id", "int_text"), "int_text", "float")[0]


@query(
    "cast_bool",
    f"""select event_id, case when lower(trim(bool_text)) in ('true', '1') then true
    when lower(trim(bool_text)) in ('false', '0') then false end as bool_text from ({NUMBERS})""",
)
def _(spark, sf_dir):
    return cleaning.cast_column(numbers(spark, sf_dir).select("event_id", "bool_text"), "bool_text", "bool")[0]


@query("cast_date", f"select event_id, {stamp('try_cast(date_text as timestamp)')} as date_text from ({NUMBERS})")
def _(spark, sf_dir):
    return plain(cleaning.cast_column(numbers(spark, sf_dir).select("event_id", "date_text"), "date_text", "date")[0])


TIMES = "select event_id, ts, event_id % 8 as k from events"
AS_TIMES = f"""select event_id, case k when 0 then date_trunc('second', ts) when 1 then date_trunc('day', ts) when 2 then date_trunc('minute', ts)
    when 3 then date_trunc('day', ts) when 4 then date_trunc('day', ts) when 5 then date_trunc('day', ts)
    when 7 then date_trunc('second', ts) - interval 2 hour end as t from ({TIMES})"""


@query("cast_date_formats", f"select event_id, {stamp('t')} as time_text from ({AS_TIMES})")
def _(spark, sf_dir):
    """Zones, minutes only, month names, and day first by the vote of the column."""
    patterns = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "dd-MMM-yyyy", "yyyy-MM-dd HH:mm", "dd/MM/yyyy", "MMMM dd, yyyy", "yyyy-MM-dd", "'sometime'", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"]
    text = F.coalesce(*[F.when(F.col("event_id") % 8 == i, F.date_format("ts", p)) for i, p in enumerate(patterns)])
    df = table(spark, sf_dir, "events").select("event_id", text.alias("time_text"))
    return plain(cleaning.cast_column(df, "time_text", "date")[0])


@query("cast_date_log", f"select count(*) filter (where k = 6) as lost, count(*) as rows from ({TIMES})")
def _(spark, sf_dir):
    """Values that are no date are counted in the log."""
    df = table(spark, sf_dir, "events").selectExpr("if(event_id % 8 = 6, 'sometime', date_format(ts, 'dd/MM/yyyy HH:mm')) as t")
    return spark.createDataFrame([(cleaning.cast_column(df, "t", "date")[1]["lost"], df.count())], "lost bigint, rows bigint")


@query("dedupe_maps", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def _(spark, sf_dir):
    """Maps with the same entries in another order are the same row."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_orderkey % 2 = 0, map('f', l_returnflag, 's', l_linestatus), map('s', l_linestatus, 'f', l_returnflag)) as m", "l_linenumber"
    )
    return plain(cleaning.remove_duplicates(df).selectExpr("m['f'] as l_returnflag", "m['s'] as l_linestatus", "l_linenumber"))


@query("cast_encode", "select p_partkey, dense_rank() over (order by p_type) - 1 as p_type, p_brand from part")
def _(spark, sf_dir):
    return plain(cleaning.label_encode(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), "p_type"))


@query(
    "cast_encode_large",
    """select o_orderkey, dense_rank() over (order by o_custkey) - 1 as o_custkey, o_orderstatus from orders""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return plain(cleaning.label_encode(df, "o_custkey", small=0))  # the way taken beyond the size check


@query("cast_encode_texts", "select doc_id, dense_rank() over (order by text) - 1 as text from documents")
def _(spark, sf_dir):
    """Long texts as values: the dictionary is dealt by ranges, and its bytes decide how it is attached."""
    return plain(cleaning.label_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", small=1 << 20))


@query("cast_auto", f"select event_id, try_cast(whole_text as bigint) as whole_text from ({NUMBERS})")
def _(spark, sf_dir):
    return plain(cleaning.cast_column(numbers(spark, sf_dir).select("event_id", "whole_text"), "whole_text", "auto")[0])


INFER = [
    ("event_id", "int"),
    ("int_text", "string"),
    ("whole_text", "int"),
    ("bool_text", "string"),
    ("date_text", "string"),
    ("good_date", "date"),
    ("half", "float"),
]


@query(
    "infer_type",
    f"""with src as (select *, case when date_text <> 'bad' then date_text end as good_date, event_id / 2.0 as half
    from ({NUMBERS})), t as ("""
    + " union all ".join(
        f"""select '{c}' as "column", count({c}) as n, count(try_cast({c} as double)) as num,
        count(*) filter (where try_cast({c} as double) = floor(try_cast({c} as double))) as whole,
        count(try_cast(cast({c} as varchar) as date)) as dates from src"""
        for c, _ in INFER
    )
    + """) select "column", case when num = n and whole = n then 'int' when num = n then 'float'
    when dates = n then 'date' else 'string' end as inferred from t""",
)
def _(spark, sf_dir):
    df = numbers(spark, sf_dir).selectExpr(
        "*", "case when date_text <> 'bad' then date_text end as good_date", "event_id / 2D as half"
    )
    found = casts.infer_types(df)
    return small_frame(spark, "column string, inferred string", list(found.items()))


DECLARED = {"int_text": "bigint", "date_text": "date", "no_such_column": "int"}
NUMBER_TYPES = {
    "event_id": ("bigint", "integer"),
    "int_text": ("bigint", "integer"),
    "whole_text": ("string", "string"),
    "bool_text": ("string", "string"),
    "date_text": ("date", "datetime"),
}


@query(
    "schema_override",
    report_sql(
        f"""select event_id, try_cast(int_text as bigint) as int_text, whole_text, bool_text,
        try_cast(date_text as date) as date_text from ({NUMBERS})""",
        NUMBER_TYPES,
    ),
)
def _(spark, sf_dir):
    return plain(column_report(cleaning.apply_schema(numbers(spark, sf_dir), DECLARED)))


@query(
    "declared_types",
    report_sql(f"select * from ({NUMBERS})", {**NUMBER_TYPES, "int_text": ("bigint", "string"), "date_text": ("date", "string")}),
)
def _(spark, sf_dir):
    return plain(with_declared_types(column_report(numbers(spark, sf_dir)), DECLARED))


@query("sanitize_names", 'select o_orderkey as orderkey, o_custkey as "cust key", o_orderstatus as status_1 from orders')
def _(spark, sf_dir):
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as `order-key!`", "o_custkey as `cust key?`", "o_orderstatus as `status_1.`"
    )
    return sanitize_names(df)


# --- recipes ----------------------------------------------------------------------------

STEPS = [
    {"action": "drop_columns", "columns": ["const_col", "no_such_column"]},
    {"action": "remove_duplicates"},
    {"action": "general_clean"},
    {"action": "smart_impute", "columns": ["o_totalprice"], "method": "mean"},
    {"action": "smart_impute", "columns": ["o_orderpriority"], "method": "mode"},
    {"action": "smart_impute", "columns": ["o_orderstatus"], "method": "mean"},
    {"action": "cast_schema", "columns": ["o_orderstatus"], "method": "encode"},
]
UNIQUE = f"select distinct * exclude (const_col) from ({BLANKED})"
CLEANED = f"""select o_orderkey, o_custkey, dense_rank() over (order by o_orderstatus) - 1 as o_orderstatus, o_orderdate,
    coalesce(o_totalprice, (select avg(o_totalprice) from ({UNIQUE}))) as o_totalprice,
    coalesce(o_orderpriority, (select o_orderpriority from ({UNIQUE}) where o_orderpriority is not null
        group by o_orderpriority order by count(*) desc, o_orderpriority limit 1)) as o_orderpriority,
    sparse_val from ({UNIQUE})"""


@query(
    "clean_recipe",
    "select " + ", ".join(f"{e} as {c}" for c, e in SHOWN.items() if c != "const_col") + f" from ({CLEANED})",
)
def _(spark, sf_dir):
    return plain(clean(dirty(spark, sf_dir), STEPS).frame, 4)


@query(
    "clean_log",
    f"""with src as ({BLANKED}), u as ({UNIQUE}) select step_no::bigint as step_no, action, status, metric, value from (values
    (1, 'drop_columns', 'done', 'dropped', 'const_col'), (1, 'drop_columns', 'done', 'count', '1'),
    (2, 'remove_duplicates', 'done', 'duplicates_removed',
        cast((select count(*) from src) - (select count(*) from u) as varchar)),
    (2, 'remove_duplicates', 'done', 'status', 'optimized'), (2, 'remove_duplicates', 'done', 'columns_affected', 'all'),
    (3, 'general_clean', 'skipped', 'reason', 'no such step'),
    (4, 'smart_impute', 'done', 'column', 'o_totalprice'), (4, 'smart_impute', 'done', 'strategy_used', 'mean'),
    (4, 'smart_impute', 'done', 'nulls_fixed', cast((select count(*) - count(o_totalprice) from u) as varchar)),
    (5, 'smart_impute', 'done', 'column', 'o_orderpriority'), (5, 'smart_impute', 'done', 'strategy_used', 'mode'),
    (5, 'smart_impute', 'done', 'nulls_fixed', cast((select count(*) - count(o_orderpriority) from u) as varchar)),
    (6, 'smart_impute', 'done', 'imputed', 'False'),
    (6, 'smart_impute', 'done', 'reason', 'no missing values in ''o_orderstatus'''),
    (7, 'cast_schema', 'done', 'column', 'o_orderstatus'), (7, 'cast_schema', 'done', 'strategy_used', 'encode'),
    (7, 'cast_schema', 'done', 'old_type', 'string'), (7, 'cast_schema', 'done', 'new_type', 'bigint'),
    (7, 'cast_schema', 'done', 'success', 'True')) t(step_no, action, status, metric, value)""",
)
def _(spark, sf_dir):
    log = clean(dirty(spark, sf_dir), STEPS).log
    return plain(log.where("metric <> 'fill_value'").drop("error"))


CLEAN_TYPES = {c: t for c, t in DIRTY_TYPES.items() if c != "const_col"}
CLEAN_TYPES["o_orderstatus"] = ("bigint", "integer")


@query("clean_then_analyze", report_sql(CLEANED, CLEAN_TYPES))
def _(spark, sf_dir):
    done = clean(dirty(spark, sf_dir), STEPS)
    return plain(with_declared_types(column_report(done.frame), done.declared))
