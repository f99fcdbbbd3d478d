"""Validation, text, drift and label checks."""

from __future__ import annotations

from framevitals.operators import drift, labels, quality, statistics, text, validation
from framevitals.operators.profile import profile
from suite.fixtures import (
    DIRTY_TYPES, TEXT_NUMBERS, fixture, named, plain, quality_parts, query, report_sql, table, union,
)
from suite.profiling import COLS, DIRTY, dirty

NUMBERS = named(TEXT_NUMBERS)


@query(
    "outliers_zscore",
    union(
        [
            f"select '{c}' as \"column\", round(m, 6) as mean, round(s, 6) as std, "
            f"count(*) filter (where abs(({c} - m) / s) > 3) as outliers, "
            f"round(count(*) filter (where abs(({c} - m) / s) > 3)::double / count(*), 4) as ratio "
            f"from events, (select avg({c}) as m, stddev_samp({c}) as s from events) group by m, s"
            for c in ("event_id", "user_id", "value")
        ]
    ),
)
def _(spark, sf_dir):
    return plain(statistics.outliers_zscore(table(spark, sf_dir, "events")))


BITS = " || ".join(f"case when {c} is null then '1' else '0' end" for c in COLS)
GONE = ", ".join(f"case when {c} is null then '{c}' end" for c in COLS)


@query(
    "missing_patterns",
    f"""select {BITS} as pattern, concat_ws(',', {GONE}) as columns, count(*) as n,
    round(count(*)::double / (select count(*) from ({DIRTY})), 4) as share from ({DIRTY}) group by all""",
)
def _(spark, sf_dir):
    return plain(validation.missing_patterns(dirty(spark, sf_dir)))


@query(
    "rare_classes",
    """with h as (select source as label, count(*) as n from documents group by source)
    select label, n, round(n::double / (select sum(n) from h), 4) as share from h
    where n::double / (select sum(n) from h) < 0.2""",
)
def _(spark, sf_dir):
    return plain(labels.rare_classes(table(spark, sf_dir, "documents"), "source", below=0.2))


@query(
    "label_conflicts",
    f"""select o_custkey, o_orderpriority, count(distinct o_orderstatus) as n_labels, count(*) as n_rows from ({DIRTY})
    where o_orderstatus is not null group by all having count(distinct o_orderstatus) > 1""",
)
def _(spark, sf_dir):
    return plain(labels.label_conflicts(dirty(spark, sf_dir), "o_orderstatus", ["o_custkey", "o_orderpriority"]))


MIXED = """select o_orderkey, case when o_orderkey % 5 = 0 then lower(o_orderpriority)
    when o_orderkey % 7 = 0 then concat(' ', o_orderpriority) else o_orderpriority end as priority from {orders}"""
VARIANTS = f"""with h as (select priority as v, count(*) as n from ({named(MIXED)}) group by priority)
    select 'priority' as "column", lower(trim(v)) as normal, count(*) as spellings, sum(n)::bigint as n,
    arg_min(v, {{'a': -n, 'b': v}}) as preferred from h group by lower(trim(v)) having count(*) > 1"""


@query("category_variants", VARIANTS)
def _(spark, sf_dir):
    return plain(validation.category_variants(fixture(spark, sf_dir, MIXED)))


@query(
    "normalize_categories",
    f"""select o_orderkey, coalesce(preferred, priority) as priority from ({named(MIXED)}) m
    left join ({VARIANTS}) v on lower(trim(m.priority)) = v.normal""",
)
def _(spark, sf_dir):
    return plain(validation.normalize_categories(fixture(spark, sf_dir, MIXED), "priority"))


RULES = {"l_quantity": (5.0, 45.0), "l_discount": (None, 0.08), "l_tax": (0.01, None)}


@query(
    "range_check",
    union(
        [
            f"select '{c}' as \"column\", {lo if lo is not None else 'null'}::double as lower, "
            f"{hi if hi is not None else 'null'}::double as upper, "
            f"count(*) filter (where {c} < {lo if lo is not None else 'null'}::double) as below, "
            f"count(*) filter (where {c} > {hi if hi is not None else 'null'}::double) as above, "
            f"count(*) filter (where {c} < {lo if lo is not None else '-1e300'}::double "
            f"or {c} > {hi if hi is not None else '1e300'}::double) as violations, "
            f"round(count(*) filter (where {c} < {lo if lo is not None else '-1e300'}::double "
            f"or {c} > {hi if hi is not None else '1e300'}::double)::double / count(*), 4) as ratio from lineitem"
            for c, (lo, hi) in RULES.items()
        ]
    ),
)
def _(spark, sf_dir):
    return plain(validation.range_check(table(spark, sf_dir, "lineitem"), RULES))


@query(
    "format_check",
    f"""select 'whole_text' as "column", 'pattern' as kind, count(whole_text) as present,
    count(*) filter (where not regexp_matches(whole_text, '^[0-9]{{2}}$')) as invalid,
    round(count(*) filter (where not regexp_matches(whole_text, '^[0-9]{{2}}$'))::double / count(whole_text), 4) as ratio
    from ({NUMBERS})
    union all select 'date_text', 'date', count(date_text), count(*) filter (where try_cast(date_text as date) is null),
    round(count(*) filter (where try_cast(date_text as date) is null)::double / count(date_text), 4) from ({NUMBERS})""",
)
def _(spark, sf_dir):
    df = fixture(spark, sf_dir, TEXT_NUMBERS)
    return plain(validation.format_check(df, {"whole_text": "^[0-9]{2}$"}, {"date_text": ["yyyy-MM-dd"]}))


CLEAN = "trim(regexp_replace(regexp_replace({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query("text_clean", f"select doc_id, {CLEAN.format(c='text')} as text, {CLEAN.format(c='source')} as source from documents")
def _(spark, sf_dir):
    return text.text_clean(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query(
    "text_issues",
    union(
        [
            f"select '{c}' as \"column\", count({c}) as present, count(*) filter (where {c} <> trim({c})) as padded, "
            f"count(*) filter (where regexp_matches({c}, '[ \\t\\n\\r]{{2,}}')) as spaced, "
            f"count(*) filter (where regexp_matches({c}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')) as control, "
            f"count(*) filter (where contains({c}, '�')) as replacement from documents"
            for c in ("text", "lang", "source")
        ]
    ),
)
def _(spark, sf_dir):
    return plain(text.text_issues(table(spark, sf_dir, "documents")))


OLD = "select o_custkey, o_orderstatus, o_totalprice from {orders}"
NEW = """select o_custkey, case when o_orderkey % 4 = 0 then 'F' else o_orderstatus end as o_orderstatus,
    case when o_orderkey % 9 = 0 then null else o_totalprice * 1.2 end as o_totalprice from {orders}"""


def psi_sql() -> str:
    cuts = ", ".join(str(i / 10) for i in range(1, 10))
    groups = {
        "o_custkey": f"cast(len(list_filter((select list_distinct(quantile_cont(o_custkey::double, [{cuts}])) from old), lambda e: o_custkey::double > e)) as varchar)",
        "o_orderstatus": "o_orderstatus",
        "o_totalprice": f"cast(len(list_filter((select list_distinct(quantile_cont(o_totalprice::double, [{cuts}])) from old), lambda e: o_totalprice::double > e)) as varchar)",
    }
    parts = []
    for c, g in groups.items():
        value = f"case when {c} is not null then {g} end"
        parts.append(
            f"""select '{c}' as "column", sum((q - p) * ln(q / p)) as psi from (
            select greatest(coalesce(a.n, 0)::double / (select count(*) from old), 0.0001) as p,
                   greatest(coalesce(b.n, 0)::double / (select count(*) from new), 0.0001) as q
            from (select {value} as g, count(*) as n from old group by all) a
            full join (select {value} as g, count(*) as n from new group by all) b on a.g is not distinct from b.g)"""
        )
    return (
        f"with old as ({named(OLD)}), new as ({named(NEW)}), t as ({union(parts)}) "
        "select \"column\", round(psi, 4) as psi, case when psi < 0.1 then 'stable' when psi < 0.25 then 'shifted' "
        "else 'drifted' end as band from t"
    )


@query("drift_psi", psi_sql())
def _(spark, sf_dir):
    return plain(drift.drift_psi(fixture(spark, sf_dir, OLD), fixture(spark, sf_dir, NEW)))


V1 = f"select o_orderkey, o_orderstatus, o_totalprice, o_orderpriority from ({DIRTY})"
V2 = "select o_orderkey, o_orderstatus, o_totalprice, o_custkey from orders"
T1 = {c: DIRTY_TYPES[c] for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")}
T2 = {c: DIRTY_TYPES[c] for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")}


@query(
    "version_diff",
    f"""with a as ({report_sql(V1, T1)}), b as ({report_sql(V2, T2)})
    select coalesce(a."column", b."column") as "column",
    case when a."column" is null then 'added' when b."column" is null then 'removed'
         when a.type <> b.type or a.rows <> b.rows or a.missing_pct <> b.missing_pct or a.n_unique <> b.n_unique
         then 'changed' else 'same' end as status,
    a.type as old_type, b.type as new_type, a.rows as old_rows, b.rows as new_rows, a.missing_pct as old_missing_pct,
    b.missing_pct as new_missing_pct, a.n_unique as old_n_unique, b.n_unique as new_n_unique
    from a full join b on a."column" = b."column" """,
)
def _(spark, sf_dir):
    old = dirty(spark, sf_dir).select(*T1)
    return plain(drift.version_diff(old, table(spark, sf_dir, "orders").select(*T2)))


CONSISTENCY = f"""with src as ({NUMBERS}), t as (""" + union(
    [
        f"select '{c}' as \"column\", count({c}) as present, count(try_cast({c} as double)) as numbers, "
        f"count(*) filter (where try_cast({c} as double) is null and try_cast({c} as date) is not null) as dates from src"
        for c in ("int_text", "whole_text", "bool_text", "date_text")
    ]
) + """), w as (select *, present - numbers - dates as words from t)
    select *, case when words >= numbers and words >= dates then 'text' when numbers >= dates then 'number' else 'date' end
    as main, present - greatest(numbers, dates, words) as mismatches from w"""


@query("type_consistency", CONSISTENCY)
def _(spark, sf_dir):
    return plain(validation.type_consistency(fixture(spark, sf_dir, TEXT_NUMBERS)))


@query(
    "score_breakdown",
    f"""with {quality_parts(NUMBERS, ['event_id', 'int_text', 'whole_text', 'bool_text', 'date_text'])},
    k as (select 1 - sum(mismatches)::double / sum(present) as k from ({CONSISTENCY}))
    select round(1 - m, 4) as completeness, round(1 - d, 4) as uniqueness, round(k, 4) as consistency,
    round((1 - m + 1 - d + k) / 3, 4) as overall_score from q, k""",
)
def _(spark, sf_dir):
    df = fixture(spark, sf_dir, TEXT_NUMBERS)
    rows = validation.type_consistency(df).agg({"mismatches": "sum", "present": "sum"}).first()
    consistency = 1 - rows["sum(mismatches)"] / rows["sum(present)"]
    return plain(quality.score_breakdown(profile(df), consistency))


MEASURES = """select p_partkey, concat(cast(p_size as varchar(10)), case when p_partkey % 3 = 0 then ' kg'
    when p_partkey % 3 = 1 then 'g' else '' end) as weight from {part}"""


@query(
    "unit_mix",
    f"""with u as (select regexp_extract(weight, '([A-Za-z]*)$', 1) as unit from ({named(MEASURES)}))
    select 'weight' as "column", unit, count(*) as n, round(count(*)::double / (select count(*) from u), 4) as share
    from u group by unit""",
)
def _(spark, sf_dir):
    return plain(validation.unit_mix(fixture(spark, sf_dir, MEASURES)))


@query(
    "schema_check",
    f"""with src as ({NUMBERS}) select t.c as "column", t.expected, t.actual, t.status,
    case t.c when 'event_id' then (select count(event_id) from src) when 'int_text' then (select count(int_text) from src)
        when 'date_text' then (select count(date_text) from src) when 'bool_text' then (select count(bool_text) from src)
        when 'whole_text' then (select count(whole_text) from src) end as present,
    case t.c when 'int_text' then (select count(int_text) - count(try_cast(int_text as bigint)) from src)
        when 'date_text' then (select count(date_text) - count(try_cast(date_text as date)) from src)
        when 'note' then null else 0 end as misfits
    from (values ('event_id', 'bigint', 'bigint', 'ok'), ('int_text', 'bigint', 'string', 'type'),
    ('date_text', 'date', 'string', 'type'), ('note', 'string', null, 'missing'), ('whole_text', null, 'string', 'extra'),
    ('bool_text', null, 'string', 'extra')) t(c, expected, actual, status)""",
)
def _(spark, sf_dir):
    df = fixture(spark, sf_dir, TEXT_NUMBERS)
    return plain(validation.schema_check(df, "event_id bigint, int_text bigint, date_text date, note string"))
