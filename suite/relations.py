"""Correlation, leakage and duplicate columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from framevitals.operators import correlation, leakage
from suite.fixtures import DOCS_DUP, LINE_LEAK, fixture, named, plain, query, table, union

LEAK = named(LINE_LEAK)
FEATURES = ["l_orderkey", "l_linenumber", "l_quantity", "price_x2", "net", "charged", "const_num"]


def r_sql(x: str, y: str) -> str:
    return f"case when isnan(corr({x}::double, {y}::double)) then null else corr({x}::double, {y}::double) end"


CORR = f"with src as ({LEAK}), t as (" + union(
    [f"select '{c}' as feature, {r_sql(c, 'l_extendedprice')} as r from src" for c in FEATURES]
) + """) select feature, round(r, 6) as r,
    case when abs(r) >= 0.9999 then 'perfect' when abs(r) >= 0.9 then 'high' end as band from t"""


@query("corr_target", CORR)
def _(spark, sf_dir):
    return plain(correlation.corr_target(fixture(spark, sf_dir, LINE_LEAK), "l_extendedprice"))


@query("leakage_features", f"select * from ({CORR}) where band is not null")
def _(spark, sf_dir):
    return plain(leakage.leakage_features(fixture(spark, sf_dir, LINE_LEAK), "l_extendedprice"))


DUP_SQL = f"""with src as ({named(DOCS_DUP)}) select 'text_len' as "column", 'n_chars' as duplicate_of
    where (select bool_and(n_chars is not distinct from text_len) from src)
    and not (select bool_and(doc_id is not distinct from text_len) from src)"""


@query("duplicate_columns", DUP_SQL)
def _(spark, sf_dir):
    return leakage.duplicate_columns(fixture(spark, sf_dir, DOCS_DUP))


@query(
    "leakage",
    f"""with c as ({CORR}), p as (select count(*) filter (where band = 'perfect') as np,
    count(*) filter (where band = 'high') as nh,
    string_agg(feature, ',' order by feature) filter (where band = 'perfect') as perfect,
    string_agg(feature, ',' order by feature desc) filter (where band = 'high') as high from c)
    select case when np > 0 or nh > 2 then 'HIGH' when nh > 0 then 'LOW' else 'NONE' end as risk,
    coalesce(perfect, '') as perfect_predictors, coalesce(high, '') as high_correlation, '' as duplicate_columns,
    7::bigint as numeric_features, null::varchar as details from p""",
)
def _(spark, sf_dir):
    found = leakage.leakage(fixture(spark, sf_dir, LINE_LEAK), "l_extendedprice")
    lists = ("perfect_predictors", "high_correlation", "duplicate_columns")
    return plain(found.withColumns({c: F.array_join(c, ",") for c in lists}))


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
MATRIX = union(
    [f"select '{a}' as x, '{b}' as y, round({r_sql(a, b)}, 6) as r from lineitem" for a, b in combinations(NUMBERS, 2)]
)


@query("corr_matrix", MATRIX)
def _(spark, sf_dir):
    return plain(correlation.corr_matrix(table(spark, sf_dir, "lineitem"), NUMBERS))


ALL_NUMBERS = ["l_orderkey", *NUMBERS]


@query(
    "corr_matrix_gaps",
    union(
        [
            f"select '{a}' as x, '{b}' as y, round({r_sql(a, b)}, 6) as r from (select " + ", ".join(
                f"case when (l_orderkey + {i}) % {i + 2} = 0 then null else {c} end as {c}" for i, c in enumerate(ALL_NUMBERS)
            ) + ", 0.1::double as fixed from lineitem)"
            for a, b in combinations([*ALL_NUMBERS, "fixed"], 2)
        ]
    ),
)
def _(spark, sf_dir):
    """All numeric columns and a constant, each with its own gaps, from one scan."""
    df = table(spark, sf_dir, "lineitem").select(
        *[F.when((F.col("l_orderkey") + i) % (i + 2) != 0, F.col(c)).alias(c) for i, c in enumerate(ALL_NUMBERS)], F.lit(0.1).alias("fixed")
    )
    return plain(correlation.corr_matrix(df))


LEAK_NUMBERS = ["l_quantity", "l_extendedprice", "price_x2", "net", "charged", "const_num"]
LEAK_PAIRS = f"with src as ({LEAK}), t as (" + union(
    [f"select '{a}' as x, '{b}' as y, {r_sql(a, b)} as r from src" for a, b in combinations(LEAK_NUMBERS, 2)]
) + ") select x, y, round(r, 6) as r from t where abs(r) > 0.9"


@query("collinear_pairs", LEAK_PAIRS)
def _(spark, sf_dir):
    return plain(correlation.collinear_pairs(fixture(spark, sf_dir, LINE_LEAK), LEAK_NUMBERS))


def vif2_sql(a: str, b: str) -> str:
    return f"round(1 / (1 - pow(corr({a}, {b}), 2)), 4)"


@query(
    "variance_inflation",
    f"""select 'l_quantity' as "column", {vif2_sql('l_quantity', 'l_extendedprice')} as vif from lineitem
    union all select 'l_extendedprice', {vif2_sql('l_quantity', 'l_extendedprice')} from lineitem""",
)
def _(spark, sf_dir):
    found = correlation.variance_inflation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return plain(found.select("column", "vif"), 4)


TWO = "(select corr(l_quantity, l_extendedprice) as r from lineitem)"


@query(
    "variance_inflation_singular",
    f"""select 'quantity' as "column", null::double as vif, 'twice' as dependent_on union all select 'twice', null, 'quantity'
    union all select 'price', round(1 / (1 - r * r), 4), null from {TWO} union all select 'fixed', null, 'constant'""",
)
def _(spark, sf_dir):
    """A doubled column makes its pair infinite and no other; a constant has a row too."""
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_quantity as double) as quantity", "2 * cast(l_quantity as double) as twice", "l_extendedprice as price", "7.0D as fixed"
    )
    return plain(correlation.variance_inflation(df), 4)
