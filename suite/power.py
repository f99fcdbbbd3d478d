"""Predictive power: task, prepared features, mutual information, score, signal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from framevitals.functions.quantiles import exact_quantiles
from framevitals.operators import predictive
from framevitals.operators.statistics import stats_numeric
from framevitals.plans.views import signal_table
from suite.fixtures import LABELED, fixture, named, plain, query, table, union
from suite.profiling import DIRTY, dirty, numeric_sql

LABELS = named(LABELED)
TARGETED = f"select * from ({DIRTY}) where o_totalprice is not null"
KNOWN = f"""select *, coalesce(sparse_val, (select quantile_cont(sparse_val, 0.5) from ({TARGETED}))) as sparse_fill
    from ({TARGETED})"""
BINS = 16


def edges_sql(column: str, source: str, bins: int = BINS) -> str:
    cuts = ", ".join(str(i / bins) for i in range(1, bins))
    return f"(select list_distinct(quantile_cont({column}::double, [{cuts}])) from ({source}))"


def bin_sql(value: str, column: str, source: str) -> str:
    return f"len(list_filter({edges_sql(column, source)}, lambda e: ({value})::double > e))"


# (feature, discrete, value, key in the contingency table or None when it is the value, numeric)
DIRTY_FEATURES = [
    ("o_orderkey", False, "o_orderkey::double", bin_sql("o_orderkey", "o_orderkey", KNOWN), True),
    ("o_custkey", False, "o_custkey::double", bin_sql("o_custkey", "o_custkey", KNOWN), True),
    ("o_orderstatus", True, "coalesce(o_orderstatus, 'missing')", None, False),
    ("o_orderdate_year", True, "coalesce(year(o_orderdate), 0)", None, True),
    ("o_orderdate_month", True, "coalesce(month(o_orderdate), 0)", None, True),
    ("o_orderdate_day", True, "coalesce(day(o_orderdate), 0)", None, True),
    ("o_orderpriority", True, "coalesce(o_orderpriority, 'missing')", None, False),
    ("sparse_val_missing", True, "case when sparse_val is null then 1::bigint else 0::bigint end", None, True),
    ("sparse_val", False, "sparse_fill", bin_sql("sparse_fill", "sparse_val", KNOWN), True),
]
DIRTY_Y = bin_sql("o_totalprice", "o_totalprice", KNOWN)
LABEL_FEATURES = [
    ("doc_id", False, "doc_id::double", bin_sql("doc_id", "doc_id", LABELS), True),
    ("lang", True, "coalesce(lang, 'missing')", None, False),
    ("source", True, "coalesce(source, 'missing')", None, False),
    ("n_chars", False, "n_chars::double", bin_sql("n_chars", "n_chars", LABELS), True),
    ("quality", True, "quality::double", None, True),
]


def mi_sql(source: str, y: str, features: list[tuple], key: str | None = None, runs: int = 1) -> str:
    """CTEs ending in mi(position, feature, discrete, r, mi)."""
    member = f"md5(cast({key} as varchar))" if key else "''"
    long = union(
        [
            f"select {i}::bigint as position, cast({cell or value} as varchar) as x, cast({y} as varchar) as y, {member} as h from known"
            for i, (_, _, value, cell, _) in enumerate(features)
        ]
    )
    names = ", ".join(f"({i}::bigint, '{f[0]}', {str(f[1]).lower()})" for i, f in enumerate(features))
    keep = "substr(h, 1 + 4 * cast(r as integer), 4) < 'cccd'" if key else "true"
    return f"""known as (select * from ({source})), long as ({long}),
    member as (select position, x, y, r from long, range({runs}) t(r) where {keep}),
    nxy as (select position, r, x, y, count(*)::double as n from member group by all),
    nx as (select position, r, x, sum(n) as n from nxy group by all),
    ny as (select position, r, y, sum(n) as n from nxy group by all),
    sxy as (select position, r, sum(n) as n, sum(n * ln(n)) as s from nxy group by all),
    sx as (select position, r, sum(n * ln(n)) as s from nx group by all),
    sy as (select position, r, sum(n * ln(n)) as s from ny group by all),
    names(position, feature, discrete) as (values {names}),
    mi as (select sxy.position, feature, discrete, sxy.r, greatest(ln(sxy.n) + (sxy.s - sx.s - sy.s) / sxy.n, 0.0) as mi
           from sxy join sx using (position, r) join sy using (position, r) join names on names.position = sxy.position)"""


def power_sql(source: str, y: str, features: list[tuple], key: str, number: str | None) -> str:
    corr = union(
        [
            f"select {i} as position, coalesce(abs(corr(({value})::double, {number}::double)), 0.0) as corr from known"
            if numeric and number
            else f"select {i} as position, 0.0::double as corr"
            for i, (_, _, value, _, numeric) in enumerate(features)
        ]
    )
    return f"""with {mi_sql(source, y, features, key, 5)}, c as ({corr}),
    agg as (select position, feature, avg(mi) as m, stddev_pop(mi) as s from mi group by position, feature),
    n as (select agg.*, corr, m / (max(m) over () + 1e-6) as norm,
          case when m <= 1e-6 then 0.0 else greatest(0.0, 1 - s / (m + 1e-6)) end as stability
          from agg join c using (position))
    select position, feature, round((0.6 * norm + 0.4 * corr) * stability, 4) as score, round(m, 4) as mi,
    round(corr, 4) as corr, round(stability, 4) as stability, norm > 0.95 and stability > 0.9 as leakage_risk from n"""


@query(
    "task_type",
    f"""select 'o_orderstatus' as target, 'string' as family, count(distinct o_orderstatus) as n_unique, count(o_orderstatus) as rows,
    'classification' as task from ({DIRTY})
    union all select 'o_totalprice', 'fractional', count(distinct o_totalprice), count(o_totalprice), 'regression' from ({DIRTY})
    union all select 'o_custkey', 'integer', count(distinct o_custkey), count(o_custkey),
    case when count(distinct o_custkey) < least(20, 0.1 * count(o_custkey)) then 'classification' else 'regression' end
    from ({DIRTY})
    union all select 'toxic', 'integer', count(distinct toxic), count(toxic),
    case when count(distinct toxic) < least(20, 0.1 * count(toxic)) then 'classification' else 'regression' end from labels""",
)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir)
    parts = [predictive.task_type(df, t) for t in ("o_orderstatus", "o_totalprice", "o_custkey")]
    parts.append(predictive.task_type(table(spark, sf_dir, "labels"), "toxic"))
    return plain(reduce(DataFrame.unionByName, parts))


@query("drop_missing_target", f"select o_orderkey, o_orderstatus, round(o_totalprice, 4) as o_totalprice from ({KNOWN})")
def _(spark, sf_dir):
    df = predictive.drop_missing_target(dirty(spark, sf_dir), "o_totalprice")
    return plain(df.select("o_orderkey", "o_orderstatus", "o_totalprice"), 4)


@query(
    "feat_prepare",
    "select o_orderkey, round(o_totalprice, 4) as o_totalprice, "
    + ", ".join(
        f"round({v}, 4) as {f}" if f in ("o_custkey", "sparse_val") else f"{v} as {f}"
        for f, _, v, _, _ in DIRTY_FEATURES
        if f != "o_orderkey"
    )
    + f" from ({KNOWN})",
)
def _(spark, sf_dir):
    return plain(predictive.prepare_features(dirty(spark, sf_dir), "o_totalprice", keep=["o_orderkey"]), 4)


@query(
    "feature_list",
    "select * from (values "
    + ", ".join(f"({i}::bigint, '{f[0]}', {str(f[1]).lower()})" for i, f in enumerate(DIRTY_FEATURES))
    + ") t(position, feature, discrete)",
)
def _(spark, sf_dir):
    return plain(predictive.feature_list(dirty(spark, sf_dir), "o_totalprice"))


@query("feat_datetime", "select event_id, event_type, year(ts) as ts_year, month(ts) as ts_month, day(ts) as ts_day from events")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return plain(predictive.prepare_features(df, "event_type", keep=["event_id"]))


MI_COLUMNS = "select position, feature, discrete, round(mi, 6) as mi from mi"


@query(
    "mi_discrete",
    f"""with {mi_sql(DIRTY, "o_orderstatus", [f for f in DIRTY_FEATURES if f[1] and f[0] not in ('o_orderstatus', 'sparse_val_missing')])}
    {MI_COLUMNS}""",
)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir).select("o_orderstatus", "o_orderdate", "o_orderpriority", "const_col")
    return plain(predictive.mutual_information(df, "o_orderstatus"))


@query("mi_binned", f"with {mi_sql(KNOWN, DIRTY_Y, DIRTY_FEATURES)} {MI_COLUMNS}")
def _(spark, sf_dir):
    return plain(predictive.mutual_information(dirty(spark, sf_dir), "o_totalprice"))


POWER = power_sql(KNOWN, DIRTY_Y, DIRTY_FEATURES, "o_orderkey", "o_totalprice")


@query("predictive_power", POWER)
def _(spark, sf_dir):
    return plain(predictive.predictive_power(dirty(spark, sf_dir), "o_totalprice", row_key=["o_orderkey"]))


@query("predictive_power_class", power_sql(LABELS, "toxic", LABEL_FEATURES, "doc_id", None))
def _(spark, sf_dir):
    return plain(predictive.predictive_power(fixture(spark, sf_dir, LABELED), "toxic", row_key=["doc_id"]))


@query(
    "signal_table",
    f"""with st as ({numeric_sql(DIRTY, {c: "x" for c in ("o_orderkey", "o_custkey", "o_totalprice", "sparse_val")}, 2)}),
    pw as ({POWER})
    select st."column", st.mean, st.std, st.q50 as median, coalesce(score, 0.0) as score, coalesce(mi, 0.0) as mi,
    case when coalesce(leakage_risk, false) or coalesce(score, 0) > 0.5 then 'Leakage' when score > 0.1 then 'Strong'
         when score > 0.01 then 'Moderate' else 'Noise' end as signal
    from st left join pw on st."column" = pw.feature""",
)
def _(spark, sf_dir):
    df = dirty(spark, sf_dir)
    return plain(signal_table(stats_numeric(df), predictive.predictive_power(df, "o_totalprice", ["o_orderkey"])))


def ross_sql(source: str, c: str, x: str, k: int = 3) -> str:
    """The nearest-neighbour estimate by ranking all distances, for a small table."""
    return f"""(with p as (select row_number() over () as i, cast({c} as varchar) as c, cast({x} as double) as x from ({source}) where {c} is not null and {x} is not null),
        n as (select c, count(*) as n_c from p group by c having count(*) > 1),
        q as (select p.*, n_c, least({k}, n_c - 1) as k from p join n using (c)),
        d as (select a.i, a.x, a.n_c, a.k, list_extract(list_sort(list(abs(b.x - a.x))), any_value(a.k)) as r from q a join q b on a.c = b.c and a.i <> b.i group by all),
        m as (select d.i, d.n_c, d.k, count(*) as m from d join q b on case when d.r > 0 then b.x > d.x - d.r and b.x < d.x + d.r else b.x = d.x end group by all),
        h as (select i + 1 as i, -0.5772156649015329 + sum(1.0::double / i) over (order by i) as psi from range(1, (select count(*) + 1 from p)) as t(i)
              union all select 1, -0.5772156649015329),
        s as (select avg(hk.psi - hn.psi - hm.psi) as v from m join h hk on hk.i = m.k join h hn on hn.i = m.n_c join h hm on hm.i = m.m)
        select greatest(0.0, v + (select psi from h where i = (select count(*) from q))) from s)"""


def table_sql(source: str, c: str, x: str) -> str:
    """Mutual information of two discrete columns."""
    return f"""(with t as (select {c} as c, {x} as x, count(*)::double as n from ({source}) group by all),
        s as (select sum(n) as total from t), a as (select c, sum(n) as n from t group by c), b as (select x, sum(n) as n from t group by x)
        select greatest(0.0, sum(t.n / total * ln(t.n * total / (a.n * b.n)))) from t join a using (c) join b using (x), s)"""


CUSTOMER = "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer"


def _knn_row(i: int, name: str, discrete: bool, method: str, value: str) -> str:
    return f"select {i} as position, '{name}' as feature, {str(discrete).lower()} as discrete, '{method}' as method, round({value}, 4) as mi"


@query(
    "mi_knn",
    union(
        [
            _knn_row(0, "c_custkey", False, "neighbours", ross_sql(CUSTOMER, "c_mktsegment", "c_custkey")),
            _knn_row(1, "c_nationkey", True, "table", table_sql(CUSTOMER, "c_mktsegment", "c_nationkey")),
            _knn_row(2, "c_acctbal", False, "neighbours", ross_sql(CUSTOMER, "c_mktsegment", "c_acctbal")),
        ]
    ),
)
def _(spark, sf_dir):
    """Continuous features against a class, by their three nearest neighbours."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return plain(predictive.mutual_information_knn(df, "c_mktsegment"), 4)


@query(
    "mi_knn_target",
    union(
        [
            _knn_row(0, "c_nationkey", True, "neighbours", ross_sql(CUSTOMER, "c_nationkey", "c_acctbal")),
            _knn_row(1, "c_mktsegment", True, "neighbours", ross_sql(CUSTOMER, "c_mktsegment", "c_acctbal")),
        ]
    ),
)
def _(spark, sf_dir):
    """Discrete features against a continuous target, by its three nearest neighbours."""
    df = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    return plain(predictive.mutual_information_knn(df, "c_acctbal"), 4)


def kraskov_sql(source: str, x: str, y: str, k: int = 3) -> str:
    """The nearest-neighbour estimate in the plane by ranking all distances, for a small table."""
    return f"""(with p0 as (select row_number() over () as i, cast({x} as double) as x, cast({y} as double) as y from ({source}) where {x} is not null and {y} is not null),
        sd as (select stddev_pop(x) / stddev_pop(y) as ratio, stddev_pop(x) > 0 and stddev_pop(y) > 0 as spread from p0),
        u as (select case when spread then round(ratio / pow(2, floor(log2(ratio)) - 9)) * pow(2, floor(log2(ratio)) - 9) else 1.0 end as f from sd),
        p as (select i, x, y * f as y, least({k}, count(*) over () - 1) as k from p0, u),
        d as (select a.i, a.x, a.y, a.k, list_extract(list_sort(list(greatest(abs(b.x - a.x), abs(b.y - a.y)))), any_value(a.k)) as r
              from p a join p b on a.i <> b.i group by all),
        m as (select d.i, d.k, count(*) filter (case when r > 0 then b.x > d.x - r and b.x < d.x + r else b.x = d.x end) as mx,
              count(*) filter (case when r > 0 then b.y > d.y - r and b.y < d.y + r else b.y = d.y end) as my from d, p b group by all),
        h as (select i + 1 as i, -0.5772156649015329 + sum(1.0::double / i) over (order by i) as psi from range(1, (select count(*) + 1 from p)) as t(i)
              union all select 1, -0.5772156649015329),
        s as (select avg(hk.psi - hx.psi - hy.psi) as v from m join h hk on hk.i = m.k join h hx on hx.i = m.mx join h hy on hy.i = m.my)
        select greatest(0.0, v + (select psi from h where i = (select count(*) from p))) from s)"""


@query(
    "mi_knn_plane",
    union(
        [
            _knn_row(0, "c_custkey", False, "plane", kraskov_sql(CUSTOMER, "c_custkey", "c_acctbal")),
            _knn_row(1, "c_nationkey", True, "neighbours", ross_sql(CUSTOMER, "c_nationkey", "c_acctbal")),
            _knn_row(2, "c_mktsegment", True, "neighbours", ross_sql(CUSTOMER, "c_mktsegment", "c_acctbal")),
        ]
    ),
)
def _(spark, sf_dir):
    """All features against a continuous target; those that are continuous too by neighbours in the plane."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return plain(predictive.mutual_information_knn(df, "c_acctbal"), 4)


PART = "select p_partkey, p_retailprice from part"


@query("mi_knn_part", _knn_row(0, "p_partkey", False, "plane", kraskov_sql(PART, "p_partkey", "p_retailprice")))
def _(spark, sf_dir):
    """A feature that the target depends on but by no straight line."""
    return plain(predictive.mutual_information_knn(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice"), 4)


EXTREME = """select case when l_orderkey % 3 = 0 then 42.0::double when l_linenumber = 1 then l_extendedprice::double * 1e300
    when l_linenumber = 2 then l_extendedprice::double * 1e-300 when l_linenumber = 3 then l_extendedprice::double * -1e-315
    when l_linenumber = 4 then 'Infinity'::double when l_linenumber = 5 then '-Infinity'::double else -l_extendedprice::double end as v from lineitem"""
EXTREME_PROBS = (0.0, 0.02, 0.1, 0.2, 0.3, 0.5, 0.6, 0.8, 0.85, 1.0)


@query(
    "quantiles_extreme",
    union([f"select {p}::double as p, quantile_cont(v, {p}) as value from ({EXTREME})" for p in EXTREME_PROBS]),
)
def _(spark, sf_dir):
    """Infinities, subnormal numbers, 600 powers of ten, and one value in a third of the rows."""
    v = table(spark, sf_dir, "lineitem").selectExpr(
        """case when l_orderkey % 3 = 0 then 42.0D when l_linenumber = 1 then cast(l_extendedprice as double) * 1e300D
           when l_linenumber = 2 then cast(l_extendedprice as double) * 1e-300D when l_linenumber = 3 then cast(l_extendedprice as double) * -1e-315D
           when l_linenumber = 4 then double('Infinity') when l_linenumber = 5 then double('-Infinity') else -cast(l_extendedprice as double) end as v"""
    )
    found = exact_quantiles(v, ["v"], EXTREME_PROBS)["v"]
    return spark.createDataFrame(list(zip(EXTREME_PROBS, found)), "p double, value double")
