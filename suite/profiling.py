"""Profile, statistics, quality, outliers and labels."""

from __future__ import annotations

from framevitals.operators import labels, quality, statistics
from framevitals.operators.profile import column_report, duplicates, profile, summary
from framevitals.plans import views
from framevitals.sources.csv import preview
from framevitals.functions.columns import blank_to_null
from suite.fixtures import (
    DIRTY_TYPES, DOCS_DUP, EVENT_TYPES, ORDERS_DIRTY, fixture, named, pct, plain, quality_parts, query,
    report_sql, stamp, table, union,
)

DIRTY = named(ORDERS_DIRTY)
COLS = list(DIRTY_TYPES)
GAPS = " + ".join(f"(count(*) - count({c}))" for c in COLS)
REPORT = report_sql(DIRTY, DIRTY_TYPES)
QUALITY = quality_parts(DIRTY, COLS)
SCORE = "round(greatest(100.0 - (40.0 * m + 25.0 * d + 20.0 * c), 0.0), 2)"
BASE = (
    "(100 - (case when rows < 100 then 20 else 0 end) - (case when cols < 3 then 15 else 0 end)"
    " - (case when m > 0.1 then 20 else 0 end) - (case when d > 0 then 10 else 0 end))"
)

SUMMARY_SQL = f"""
with src as ({DIRTY}), dd as (select count(*) as kept from (select distinct * from src))
select count(*) as rows, {len(COLS)}::bigint as cols, {pct(f'({GAPS})', f'(count(*) * {len(COLS)})')} as missing_pct,
       count(*) - (select kept from dd) as duplicates,
       {pct('(count(*) - (select kept from dd))', 'count(*)')} as duplicates_pct, 'o_totalprice' as target
from src
"""


def dirty(spark, sf_dir):
    return fixture(spark, sf_dir, ORDERS_DIRTY)


@query("summary", SUMMARY_SQL)
def _(spark, sf_dir):
    return plain(summary(dirty(spark, sf_dir), "o_totalprice"))


@query("column_report", REPORT)
def _(spark, sf_dir):
    return plain(column_report(dirty(spark, sf_dir)))


@query("column_report_events", report_sql("select * from events", EVENT_TYPES))
def _(spark, sf_dir):
    return plain(column_report(table(spark, sf_dir, "events")))


DOC_TYPES = {
    "doc_id": ("bigint", "integer"),
    "text": ("string", "string"),
    "lang": ("string", "string"),
    "source": ("string", "string"),
    "n_chars": ("bigint", "integer"),
}


@query("column_report_documents", report_sql("select * from documents", DOC_TYPES))
def _(spark, sf_dir):
    return plain(column_report(table(spark, sf_dir, "documents")))


@query(
    "column_report_nested",
    """select 0::bigint as position, 'vec_id' as "column", 'bigint' as type, 'integer' as family, count(*) as rows,
       count(*) - count(vec_id) as missing, 0.0::double as missing_pct, count(distinct vec_id) as n_unique from embeddings
       union all select 1, 'embedding', 'array<float>', 'nested', count(*), count(*) - count(embedding), 0.0::double, null
       from embeddings
       union all select 2, 'label', 'int', 'integer', count(*), count(*) - count(label), 0.0::double,
       count(distinct label) from embeddings""",
)
def _(spark, sf_dir):
    return plain(column_report(table(spark, sf_dir, "embeddings")))


@query(
    "duplicates",
    f"""with src as ({DIRTY}), dd as (select count(*) as kept from (select distinct * from src))
    select count(*) as rows, count(*) - (select kept from dd) as duplicates,
    {pct('(count(*) - (select kept from dd))', 'count(*)')} as duplicates_pct from src""",
)
def _(spark, sf_dir):
    return plain(duplicates(dirty(spark, sf_dir)))


@query(
    "profile",
    f"""with r as ({REPORT}), dup as (select count(*) - (select count(*) from (select distinct * from ({DIRTY}))) as n
    from ({DIRTY}))
    select r.position, r."column", r.type, r.family, r.rows, {len(COLS)}::bigint as cols, r.missing, r.n_unique,
           dup.n as duplicates, dup.n > 0 as any_duplicates from r, dup""",
)
def _(spark, sf_dir):
    return plain(profile(dirty(spark, sf_dir)).frame())


@query(
    "preview",
    f"""select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus,
    case when trim(o_orderpriority) = '' then '' else o_orderpriority end as o_orderpriority
    from (select * from ({DIRTY}) order by o_orderkey limit 50)""",
)
def _(spark, sf_dir):
    df = blank_to_null(dirty(spark, sf_dir)).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return preview(df, 50, ["o_orderkey"])


@query(
    "column_families",
    f"""select "column", type, case when family in ('integer', 'fractional') then 'numeric' else 'categorical' end as kind
    from ({REPORT})""",
)
def _(spark, sf_dir):
    return views.column_families(column_report(dirty(spark, sf_dir)))


# --- statistics -------------------------------------------------------------------------

LINE_NUMBERS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
}


def numeric_sql(source: str, types: dict[str, str], digits: int = 4) -> str:
    return f"with src as ({source}) " + union(
        [
            f"select '{c}' as \"column\", '{t}' as type, count({c}) as count, round(avg({c}::double), {digits}) as mean, "
            f"round(stddev_samp({c}::double), {digits}) as std, round(min({c})::double, {digits}) as min, "
            f"round(quantile_cont({c}::double, 0.25), {digits}) as q25, "
            f"round(quantile_cont({c}::double, 0.5), {digits}) as q50, "
            f"round(quantile_cont({c}::double, 0.75), {digits}) as q75, round(max({c})::double, {digits}) as max from src"
            for c, t in types.items()
        ]
    )


@query("stats_numeric", numeric_sql("select * from lineitem", LINE_NUMBERS))
def _(spark, sf_dir):
    return plain(statistics.stats_numeric(table(spark, sf_dir, "lineitem")), 4)


def categorical_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"select '{c}' as \"column\", (select count({c}) from src) as count, "
            f"(select count(distinct {c}) from src) as n_unique, v as top, n as freq from "
            f"(select cast({c} as varchar) as v, count(*) as n from src where {c} is not null group by {c} "
            f"order by n desc, v limit 1)"
        )
    return f"with src as ({source}) " + union(parts)


@query("stats_categorical", categorical_sql(DIRTY, ["o_orderstatus", "o_orderpriority", "const_col"]))
def _(spark, sf_dir):
    return plain(statistics.stats_categorical(dirty(spark, sf_dir)))


@query(
    "stats_categorical_text",
    categorical_sql("select text, lang, source, n_chars > 2000 as is_long from documents", ["text", "lang", "source", "is_long"]),
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("text", "lang", "source", "n_chars > 2000 as is_long")
    return plain(statistics.stats_categorical(docs))


def datetime_sql(source: str, columns: list[str]) -> str:
    def shown(expr: str) -> str:
        return stamp(f"make_timestamp(cast(floor({expr}) as bigint))")

    return f"with src as ({source}) " + union(
        [
            f"select '{c}' as \"column\", count({c}) as count, "
            f"{stamp(f'make_timestamp(cast(sum(epoch_us({c})::hugeint) // count({c}) as bigint))')} as mean, "
            f"{stamp(f'min({c})')} as min, {shown(f'quantile_cont(epoch_us({c})::double, 0.25)')} as q25, "
            f"{shown(f'quantile_cont(epoch_us({c})::double, 0.5)')} as q50, "
            f"{shown(f'quantile_cont(epoch_us({c})::double, 0.75)')} as q75, {stamp(f'max({c})')} as max from src"
            for c in columns
        ]
    )


@query("stats_datetime", datetime_sql(DIRTY, ["o_orderdate"]))
def _(spark, sf_dir):
    return plain(statistics.stats_datetime(dirty(spark, sf_dir)))


@query("stats_datetime_events", datetime_sql("select * from events", ["ts"]))
def _(spark, sf_dir):
    return plain(statistics.stats_datetime(table(spark, sf_dir, "events")))


@query(
    "skewness",
    union([f"select '{c}' as \"column\", round(skewness({c}), 6) as skewness from events" for c in ("event_id", "user_id", "value")]),
)
def _(spark, sf_dir):
    return plain(statistics.skewness(table(spark, sf_dir, "events")))


# --- quality ----------------------------------------------------------------------------


@query(
    "quality",
    f"""with {QUALITY} select {SCORE} as score, round(m, 4) as missing_ratio, round(d, 4) as duplicate_ratio,
    round(c, 4) as constant_ratio, rows, cols from q""",
)
def _(spark, sf_dir):
    return plain(quality.quality(profile(dirty(spark, sf_dir))))


READINESS = f"""with {QUALITY} select cast(floor(greatest(round(0.6 * {BASE} + 0.4 * {SCORE}, 9), 0)) as bigint) as value,
    cast({BASE} as bigint) as base,
    concat_ws(',', case when rows < 100 then 'low_sample_size:20' end,
                   case when cols < 3 then 'insufficient_features:15' end,
                   case when m > 0.1 then 'high_missing_values:20' end,
                   case when d > 0 then 'duplicate_rows:10' end) as penalty_list,
    rows, cols, round(m, 4) as missing_ratio, true as used_data_quality from q"""


@query("ml_readiness", READINESS)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir)
    flagged = labels.imbalance(df, "o_orderstatus").first()["is_imbalanced"]
    return plain(quality.ml_readiness(profile(df), flagged).drop("penalties"))


def suggestions_sql(report: str) -> str:
    return f"""with r as ({report})
    select position, "column", 'missing' as rule, "column" || ': high missing (' ||
           printf('%.2f', missing::double / rows * 100.0) || '%) → impute or drop' as suggestion
    from r where missing::double / rows > 0.3
    union all select position, "column", 'constant', "column" || ': constant value detected → drop column'
    from r where n_unique <= 1
    union all select position, "column", 'datetime', "column" || ': potential datetime → extract temporal features'
    from r where contains(lower("column"), 'date') or contains(lower("column"), 'time')"""


SUGGESTIONS = suggestions_sql(REPORT)


@query("suggestions", SUGGESTIONS)
def _(spark, sf_dir):
    return plain(quality.suggestions(profile(dirty(spark, sf_dir))))


def magnitude_sql(v: str) -> str:
    return (
        f"case when {v} >= 1000000 then printf('%.1fM', {v} / 1000000.0) "
        f"when {v} >= 1000 then printf('%.1fk', {v} / 1000.0) else cast(cast(floor({v}) as bigint) as varchar) end"
    )


@query(
    "summary_status",
    f"""with s as ({SUMMARY_SQL}), {QUALITY}, t as (
    select 'rows' as metric, rows::double as value, 'info' as status from s
    union all select 'cols', cols::double, 'info' from s
    union all select 'missing_pct', missing_pct, case when missing_pct > 10 then 'bad' when missing_pct > 5 then 'warn'
        else 'ok' end from s
    union all select 'duplicates_pct', duplicates_pct, case when duplicates_pct > 10 then 'bad'
        when duplicates_pct > 5 then 'warn' else 'ok' end from s
    union all select 'quality_score', {SCORE}, case when {SCORE} >= 80 then 'ok' when {SCORE} >= 50 then 'warn'
        else 'bad' end from q)
    select metric, value, status, {magnitude_sql('value')} as shown from t""",
)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return plain(views.summary_status(summary(df), quality.quality(profile(df))))


@query(
    "health_table",
    f"""select "column", type, missing_pct, case when missing_pct > 50 then 'DANGER' else 'WARNING' end as status
    from ({REPORT}) where missing_pct > 0""",
)
def _(spark, sf_dir):
    return plain(views.health_table(column_report(dirty(spark, sf_dir))))


@query(
    "cardinality_table",
    f"""select "column", type, n_unique, case when n_unique::double / rows > 0.5 then 'High' else 'Optimal' end as cardinality
    from ({report_sql('select * from documents', DOC_TYPES)}) where family = 'string'""",
)
def _(spark, sf_dir):
    return plain(views.cardinality_table(column_report(table(spark, sf_dir, "documents"))))


@query(
    "impute_candidates",
    f'select position, "column", missing, missing_pct from ({REPORT}) where missing > 0',
)
def _(spark, sf_dir):
    return plain(views.impute_candidates(column_report(dirty(spark, sf_dir))))


@query(
    "score",
    f"""with {QUALITY} select {SCORE} as quality_score,
    cast(floor(greatest(round(0.6 * {BASE} + 0.4 * {SCORE}, 9), 0)) as bigint) as ml_readiness,
    (select count(*) from ({SUGGESTIONS})) as issues from q""",
)
def _(spark, sf_dir):
    p = profile(dirty(spark, sf_dir))
    return plain(views.score(quality.quality(p), quality.ml_readiness(p), quality.suggestions(p)))


# --- outliers and labels ----------------------------------------------------------------


def outliers_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"select '{c}' as \"column\", round(q1, 6) as q1, round(q3, 6) as q3, round(q1 - 1.5 * (q3 - q1), 6) as lower, "
        f"round(q3 + 1.5 * (q3 - q1), 6) as upper, "
        f"count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outliers, "
        f"round(count(*) filter (where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))::double / count(*), 4) "
        f"as ratio from src, (select quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from src) "
        f"where q3 > q1 group by q1, q3"
        for c in columns
    ]
    return f"with src as ({source}) " + union(parts)


EVENT_OUTLIERS = outliers_sql("select * from events", ["event_id", "user_id", "value"])


@query("outliers", EVENT_OUTLIERS)
def _(spark, sf_dir):
    return plain(statistics.outliers(table(spark, sf_dir, "events")))


@query("outliers_documents", outliers_sql(named(DOCS_DUP), ["doc_id", "n_chars", "text_len"]))
def _(spark, sf_dir):
    return plain(statistics.outliers(fixture(spark, sf_dir, DOCS_DUP)))


@query(
    "outlier_table",
    f"""with o as ({EVENT_OUTLIERS}), r as ({report_sql('select * from events', EVENT_TYPES)})
    select r."column", r.type, o.outliers from r join o on r."column" = o."column" where o.outliers > 0""",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return plain(views.outlier_table(column_report(df), statistics.outliers(df)))


@query(
    "column_health",
    f"""with o as ({outliers_sql(DIRTY, ["o_orderkey", "o_custkey", "o_totalprice", "sparse_val"])}), r as ({REPORT}),
    j as (select r."column", missing_pct, {pct('coalesce(o.outliers, 0)', 'r.rows')} as outlier_pct
          from r left join o on r."column" = o."column")
    select "column", missing_pct, outlier_pct,
    cast(greatest(0, round(100.0 - (missing_pct * 0.7 + outlier_pct * 0.3))) as bigint) as health from j""",
)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return plain(views.column_health(column_report(df), statistics.outliers(df)))


def distribution_sql(source: str, target: str) -> str:
    return f"""select cast({target} as varchar) as label, count(*) as n,
    round(count(*)::double / (select count(*) from ({source})), 4) as share,
    round(count(*) * 100.0::double / (select count(*) from ({source})), 1) as share_pct
    from ({source}) group by {target}"""


@query("class_distribution", distribution_sql("select * from labels", "toxic"))
def _(spark, sf_dir):
    return plain(labels.class_distribution(table(spark, sf_dir, "labels"), "toxic"))


@query("class_distribution_roles", distribution_sql("select * from conversations", "role"))
def _(spark, sf_dir):
    return plain(labels.class_distribution(table(spark, sf_dir, "conversations"), "role"))


def imbalance_sql(source: str, target: str) -> str:
    return f"""with h as (select {target} as label, count(*) as n from ({source}) group by {target}),
    s as (select count(*) as classes, sum(n)::bigint as rows, max(n) as hi, min(n) as lo,
          coalesce(sum(n) filter (where label is null), 0)::bigint as gaps from h),
    t as (select *, hi::double / rows as r, case when hi::double / rows >= 0.95 then 'EXTREME'
          when hi::double / rows >= 0.8 then 'HIGH' when hi::double / rows >= 0.6 then 'MODERATE' else 'LOW' end as sev
          from s)
    select '{target}' as target, rows, classes as num_classes,
    round(r, 4) as majority_ratio,
    round(lo::double / rows, 4) as minority_ratio,
    sev as severity, sev in ('HIGH', 'EXTREME') as is_imbalanced,
    round(gaps::double / rows, 4) as missing_ratio,
    case when classes > 1000 then 'target has too many distinct values' end as details from t"""


@query("imbalance", imbalance_sql("select * from labels", "toxic"))
def _(spark, sf_dir):
    return plain(labels.imbalance(table(spark, sf_dir, "labels"), "toxic"))


@query("imbalance_many_classes", imbalance_sql(DIRTY, "o_totalprice"))
def _(spark, sf_dir):
    return plain(labels.imbalance(dirty(spark, sf_dir), "o_totalprice"))

