"""Reports, files, audit trail, streaming and user extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framevitals.operators import audit
from framevitals.operators.profile import column_report, summary
from framevitals.plans.recipe import clean
from framevitals.plans.registry import list_checks, register_check, register_step, run_checks
from framevitals.plans.report import as_rows, full_report
from framevitals.sources import csv, reports
from framevitals.sources.scratch import fresh_path
from framevitals.streaming.profile import profile_stream
from framevitals.streaming.sketches import read_sketches, sketch_stream
from suite.fixtures import (
    EVENT_TYPES, EVENTS_IP, RANGES, fixture, named, pct, plain, query, stamp, table, union,
)
from suite.power import POWER, bin_sql, power_sql
from suite.profiling import (
    COLS, DIRTY, QUALITY, READINESS, REPORT, SCORE, SUGGESTIONS, SUMMARY_SQL, categorical_sql, datetime_sql, dirty,
    distribution_sql, imbalance_sql, numeric_sql, outliers_sql,
)

# --- full report ------------------------------------------------------------------------


def melted(sql: str, section: str, item: str, nums: list[str], txts: list[str]) -> str:
    return union(
        [
            f"select '{section}' as section, {item} as item, '{m}' as metric, round({m}::double, 4) as num, "
            f"null::varchar as txt from ({sql})"
            for m in nums
        ]
        + [
            f"select '{section}' as section, {item} as item, '{m}' as metric, null::double as num, "
            f"cast({m} as varchar) as txt from ({sql})"
            for m in txts
        ]
    )


NAME = '"column"'
ALL = "'dataset'"
DIRTY_NUMBERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "sparse_val": "double"}
SUMMARY_ROWS = melted(SUMMARY_SQL, "summary", ALL, ["rows", "cols", "missing_pct", "duplicates", "duplicates_pct"], ["target"])
COLUMN_ROWS = melted(REPORT, "column", NAME, ["position", "rows", "missing", "missing_pct", "n_unique"], ["type", "family"])
LEAKAGE = f"""select 'HIGH' as risk, 'sparse_val' as perfect_predictors, '' as high_correlation, '' as duplicate_columns,
    3 as numeric_features, null as details from ({DIRTY}) having corr(sparse_val, o_totalprice) >= 0.9999"""
FULL = union(
    [
        SUMMARY_ROWS,
        COLUMN_ROWS,
        melted(
            imbalance_sql(DIRTY, "o_totalprice"), "imbalance", ALL,
            ["rows", "num_classes", "majority_ratio", "minority_ratio", "missing_ratio"],
            ["target", "severity", "is_imbalanced", "details"],
        ),
        melted(POWER, "predictive_power", "feature", ["position", "score", "mi", "corr", "stability"], ["leakage_risk"]),
        melted(
            LEAKAGE, "leakage", ALL, ["numeric_features"],
            ["risk", "perfect_predictors", "high_correlation", "duplicate_columns", "details"],
        ),
        melted(
            f"""with {QUALITY} select {SCORE} as score, round(m, 4) as missing_ratio, round(d, 4) as duplicate_ratio,
            round(c, 4) as constant_ratio, rows, cols from q""",
            "quality", ALL, ["score", "missing_ratio", "duplicate_ratio", "constant_ratio", "rows", "cols"], [],
        ),
        melted(
            READINESS, "ml_readiness", ALL, ["value", "base", "rows", "cols", "missing_ratio"],
            ["penalty_list", "used_data_quality"],
        ),
        melted(SUGGESTIONS, "suggestion", NAME, ["position"], ["rule", "suggestion"]),
        melted(
            outliers_sql(DIRTY, list(DIRTY_NUMBERS)), "outliers", NAME,
            ["q1", "q3", "lower", "upper", "outliers", "ratio"], [],
        ),
        melted(
            numeric_sql(DIRTY, DIRTY_NUMBERS), "stats_numeric", NAME,
            ["count", "mean", "std", "min", "q25", "q50", "q75", "max"], ["type"],
        ),
        melted(
            categorical_sql(DIRTY, ["o_orderstatus", "o_orderpriority", "const_col"]), "stats_categorical", NAME,
            ["count", "n_unique", "freq"], ["top"],
        ),
        melted(
            datetime_sql(DIRTY, ["o_orderdate"]), "stats_datetime", NAME, ["count"],
            ["mean", "min", "q25", "q50", "q75", "max"],
        ),
    ]
)


@query("full_report", FULL)
def _(spark, sf_dir):
    rows = full_report(dirty(spark, sf_dir), "o_totalprice", row_key=["o_orderkey"], checks=())
    seconds = F.when(F.col("section") == "stats_datetime", F.substring("txt", 1, 19)).otherwise(F.col("txt"))
    return plain(rows.withColumn("txt", seconds), 4)


FILLED = f"""select *, coalesce(o_totalprice, (select quantile_cont(o_totalprice, 0.5) from ({DIRTY}))) as price_fill,
    coalesce(sparse_val, (select quantile_cont(sparse_val, 0.5) from ({DIRTY}))) as sparse_fill from ({DIRTY})"""
STATUS_FEATURES = [
    ("o_orderkey", False, "o_orderkey::double", bin_sql("o_orderkey", "o_orderkey", DIRTY), True),
    ("o_custkey", False, "o_custkey::double", bin_sql("o_custkey", "o_custkey", DIRTY), True),
    ("o_orderdate_year", True, "coalesce(year(o_orderdate), 0)", None, True),
    ("o_orderdate_month", True, "coalesce(month(o_orderdate), 0)", None, True),
    ("o_orderdate_day", True, "coalesce(day(o_orderdate), 0)", None, True),
    ("o_totalprice_missing", True, "case when o_totalprice is null then 1 else 0 end", None, True),
    ("o_totalprice", False, "price_fill", bin_sql("price_fill", "o_totalprice", DIRTY), True),
    ("o_orderpriority", True, "coalesce(o_orderpriority, 'missing')", None, False),
    ("sparse_val_missing", True, "case when sparse_val is null then 1 else 0 end", None, True),
    ("sparse_val", False, "sparse_fill", bin_sql("sparse_fill", "sparse_val", DIRTY), True),
]
BY_STATUS = union(
    [
        melted(
            imbalance_sql(DIRTY, "o_orderstatus"), "imbalance", ALL,
            ["rows", "num_classes", "majority_ratio", "minority_ratio", "missing_ratio"],
            ["target", "severity", "is_imbalanced", "details"],
        ),
        melted(distribution_sql(DIRTY, "o_orderstatus"), "class", "label", ["n", "share", "share_pct"], []),
        melted(
            power_sql(FILLED, "o_orderstatus", STATUS_FEATURES, "o_orderkey", None), "predictive_power", "feature",
            ["position", "score", "mi", "corr", "stability"], ["leakage_risk"],
        ),
        melted(
            f"""select 'NONE' as risk, '' as perfect_predictors, '' as high_correlation, '' as duplicate_columns,
            4 as numeric_features, null as details from ({DIRTY}) having count(*) > 0""",
            "leakage", ALL, ["numeric_features"],
            ["risk", "perfect_predictors", "high_correlation", "duplicate_columns", "details"],
        ),
    ]
)


@query("report_other_target", BY_STATUS)
def _(spark, sf_dir):
    rows = full_report(dirty(spark, sf_dir), "o_orderstatus", row_key=["o_orderkey"], checks=())
    return plain(rows.where(F.col("section").isin("imbalance", "class", "predictive_power", "leakage")), 4)


@query("report_json", f"{SUMMARY_ROWS} union all {COLUMN_ROWS}")
def _(spark, sf_dir):
    df, path = dirty(spark, sf_dir), fresh_path(spark, "reports")
    first = as_rows(summary(df), "summary").unionByName(as_rows(column_report(df), "column", "column"))
    reports.save_report(first, path, "orders")
    reports.save_report(as_rows(summary(df, "o_totalprice"), "summary"), path, "orders")  # replaces one section
    return plain(reports.load_report(spark, path, "orders"), 4)


# --- files ------------------------------------------------------------------------------

ROUND = {"o_orderdate": stamp("o_orderdate"), "o_totalprice": "round(o_totalprice, 4)", "sparse_val": "round(sparse_val, 4)"}
AS_FILE = "select " + ", ".join(f"{ROUND.get(c, c)} as {c}" for c in COLS) + f" from ({DIRTY})"


@query("csv_scan", AS_FILE)
def _(spark, sf_dir):
    path = fresh_path(spark, "orders-csv")
    csv.write_csv(dirty(spark, sf_dir), path)
    return plain(csv.read_csv(spark, path), 4)


@query(
    "csv_scan_headers",
    """select n_nationkey, n_name, case when n_nationkey % 2 = 0 then n_regionkey end as n_regionkey,
    case when n_nationkey % 2 = 1 then 'odd' end as kind from nation""",
)
def _(spark, sf_dir):
    """Files with another order of columns, and other columns, are united by name."""
    path, nation = fresh_path(spark, "nation-csv"), table(spark, sf_dir, "nation")
    csv.write_csv(nation.where("n_nationkey % 2 = 0").select("n_nationkey", "n_name", "n_regionkey"), f"{path}/a")
    csv.write_csv(nation.where("n_nationkey % 2 = 1").selectExpr("n_name", "'odd' as kind", "n_nationkey"), f"{path}/b")
    return plain(csv.read_csv(spark, [f"{path}/a", f"{path}/b"]).select("n_nationkey", "n_name", "n_regionkey", "kind"))


@query("csv_roundtrip", AS_FILE)
def _(spark, sf_dir):
    path, df = fresh_path(spark, "orders-csv"), dirty(spark, sf_dir)
    csv.write_csv(df, path)
    return plain(csv.read_csv(spark, path, schema=df.schema), 4)


@query("csv_roundtrip_text", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, sf_dir):
    path, df = fresh_path(spark, "documents-csv"), table(spark, sf_dir, "documents")
    csv.write_csv(df, path)
    return plain(csv.read_csv(spark, path, schema=df.schema, multiline=True))


@query(
    "report_corrupt",
    f"""{SUMMARY_ROWS} union all select 'status', 'dataset', 'damaged_lines', count(*)::double, null::varchar from nation where n_nationkey % 2 = 0""",
)
def _(spark, sf_dir):
    """Damaged lines beside a stored report are counted and left out."""
    path = fresh_path(spark, "reports")
    reports.save_report(as_rows(summary(dirty(spark, sf_dir), "o_totalprice"), "summary"), path, "orders")
    broken = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").selectExpr("concat('{\"item\": \"', n_name) as value")
    broken.write.mode("append").text(f"{path}/dataset_id=orders/section=summary")
    return plain(reports.load_report(spark, path, "orders"), 4)


@query(
    "validate_source_bad",
    """select 'long' as kind, 1 + count(*) as lines, count(*) filter (n_nationkey % 5 = 0) as ragged_lines,
    count(*) filter (n_nationkey % 5 = 0) as long_lines, false as ok, 'lines longer than the header' as reason from nation
    union all select 'short', 1 + count(*), count(*) filter (n_nationkey % 5 = 0), 0, true, null from nation
    union all select 'empty', 0, 0, 0, false, 'empty file' """,
)
def _(spark, sf_dir):
    """Files with lines longer or shorter than their header, and one without any."""
    path, nation = fresh_path(spark, "bad-csv"), table(spark, sf_dir, "nation")
    some = F.col("n_nationkey") % 5 == 0
    bodies = {
        "long": F.when(some, F.lit("1,\"a,b\",2")).otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(",\"x, "), "n_name", F.lit("\""))),
        "short": F.when(some, F.lit("1")).otherwise(F.concat(F.col("n_nationkey").cast("string"), F.lit(","), "n_name")),
    }
    for kind, line in bodies.items():
        lines = nation.select(F.lit(1).alias("at"), line.alias("value")).union(spark.range(1).selectExpr("0", "'key,name'"))
        lines.repartition(1).sortWithinPartitions("at").select("value").write.text(f"{path}/{kind}")
    nation.coalesce(1).where("n_nationkey < 0").select("n_name").write.text(f"{path}/empty")
    files = [csv.validate_source(spark, f"{path}/{kind}", suffix=".txt").withColumn("kind", F.lit(kind)) for kind in ("long", "short", "empty")]
    return plain(files[0].unionByName(files[1]).unionByName(files[2]).select("kind", "lines", "ragged_lines", "long_lines", "ok", "reason"))


@query(
    "validate_source",
    f"""select (select count(*) from ({DIRTY})) as data_lines, (select count(*) from ({DIRTY})) as comma_lines,
    0::bigint as ragged_lines, true as ok, null::varchar as reason""",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "orders-csv")
    csv.write_csv(dirty(spark, sf_dir), path)
    files = csv.validate_source(spark, path)
    return files.agg(
        F.sum(F.col("lines") - 1).cast("bigint").alias("data_lines"),
        F.sum(F.col("comma_lines") - 1).cast("bigint").alias("comma_lines"),
        F.sum("ragged_lines").cast("bigint").alias("ragged_lines"),
        F.bool_and("ok").alias("ok"),
        F.max("reason").alias("reason"),
    )


# --- audit ------------------------------------------------------------------------------

IPS = named(EVENTS_IP)
PUBLIC = f"select * from ({IPS}) where ip not like '10.%'"
NUMBER = """(split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536
    + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint)"""
GEO = f"""select e.*, coalesce(r.country, 'Unknown') as country from ({PUBLIC}) e
    left join ({RANGES}) r on {NUMBER} between r.lo and r.hi"""
ENTRIES = f"select event_id, {stamp('ts')} as time, cast(user_id as varchar) as user_id, event_type as slug, ip, country from ({GEO})"


def ips(spark, sf_dir):
    return fixture(spark, sf_dir, EVENTS_IP)


def log_of(spark, sf_dir):
    return audit.entries(
        ips(spark, sf_dir),
        spark.sql(RANGES),
        user=F.col("user_id"),
        role=F.lit("member"),
        slug=F.col("event_type"),
        entity=F.col("event_id"),
        delta=F.create_map(F.lit("type"), F.col("event_type")),
        timestamp=F.col("ts"),
    )


@query("audit_public_only", f"select event_id, ip from ({PUBLIC})")
def _(spark, sf_dir):
    return audit.public_only(ips(spark, sf_dir)).select("event_id", "ip")


@query("audit_geo", f"select event_id, ip, country from ({GEO})")
def _(spark, sf_dir):
    found = audit.geo_lookup(audit.public_only(ips(spark, sf_dir)), spark.sql(RANGES))
    return found.select("event_id", "ip", "country")


@query("audit_geo_large", f"select event_id, ip, country from ({GEO})")
def _(spark, sf_dir):
    events = audit.public_only(ips(spark, sf_dir))
    return audit.geo_lookup(events, spark.sql(RANGES), small=0).select("event_id", "ip", "country")


PLACES = """select event_id, (event_id * 37) % 150000 as n, event_id % 3 as k from events"""
PLACED = f"""select event_id, case k when 0 then case when n < 32768 then 'A' when n < 196608 then 'B' else 'Unknown' end
    when 1 then case when n = 5 then 'C' when n between 65536 and 65700 then 'D' else 'Unknown' end
    else case when n < 65536 then 'E' when n between 65538 and 131071 then 'F' else 'Unknown' end end as country from ({PLACES})"""
BLOCKS = """select * from values ('11.0.0.0', '11.0.127.255', 'A'), ('11.0.128.0', '11.2.255.255', 'B'), ('12.0.0.5', '12.0.0.5', 'C'),
    ('12.1.0.0', '12.1.0.164', 'D'), ('2001:db8::', '2001:db8::ffff', 'E'), ('2001:db8::1:2', '2001:db8:0:0:0:0:1:ffff', 'F') as t(lo, hi, country)"""


@query("audit_geo_blocks", PLACED)
def _(spark, sf_dir):
    """Ranges inside, across and beyond /16 blocks, single addresses, and IPv6."""
    events = spark.sql(PLACES.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))
    quad = F.expr("concat_ws('.', if(k = 0, 11, 12), n div 65536, (n div 256) % 256, n % 256)")
    six = F.expr("concat('2001:db8::', lower(hex(n div 65536)), ':', lower(hex(n % 65536)))")
    placed = events.select("event_id", F.when(F.col("k") < 2, quad).otherwise(six).alias("ip"))
    return audit.geo_lookup(placed, spark.sql(BLOCKS)).select("event_id", "country")


@query(
    "audit_entries",
    f"""select cast(event_id as varchar) as entity, time, user_id, 'member' as role, slug, slug as delta_type, ip, country,
    '—' as city from ({ENTRIES})""",
)
def _(spark, sf_dir):
    path = fresh_path(spark, "audit")
    log_of(spark, sf_dir).write.mode("append").parquet(path)
    return spark.read.parquet(path).select(
        F.col("action.entity").alias("entity"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "actor.user_id",
        "actor.role",
        "action.slug",
        F.col("action.delta").getItem("type").alias("delta_type"),
        "environment.ip",
        "environment.geo.country",
        "environment.geo.city",
    )


@query(
    "audit_recent",
    f"""select cast(event_id as varchar) as entity, {stamp('ts')} as time, event_type as slug from ({GEO})
    order by ts desc, cast(event_id as varchar) limit 100""",
)
def _(spark, sf_dir):
    newest = audit.recent(log_of(spark, sf_dir), 100, tie=("action.entity",))
    return newest.select(
        F.col("action.entity").alias("entity"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
        "action.slug",
    )


@query(
    "audit_view",
    f"""select time, substr(user_id, 1, 8) || '...' as "user", slug as action, cast(event_id as varchar) as entity,
    '—, ' || country as place, ip from ({ENTRIES})""",
)
def _(spark, sf_dir):
    return plain(audit.view(log_of(spark, sf_dir)))


# --- streaming --------------------------------------------------------------------------


@query(
    "stream_profile",
    union(
        [
            f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as missing, "
            f"{pct(f'(count(*) - count({c}))', 'count(*)')} as missing_pct from events"
            for c in EVENT_TYPES
        ]
    ),
)
def _(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque[t]")
    return plain(spark.read.parquet(profile_stream(stream)))


@query(
    "stream_sketches",
    union(
        [
            f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as missing, "
            f"{pct(f'(count(*) - count({c}))', 'count(*)')} as missing_pct, "
            + (f"min({c})::double as low, max({c})::double as high" if c in ("event_id", "user_id", "value") else "null::double as low, null::double as high")
            + ", true as distinct_near, true as median_near from events"
            for c in EVENT_TYPES
        ]
    ),
)
def _(spark, sf_dir):
    """Four micro-batches merged as sketches; counts and limits exact, distinct values and the median held against exact ones."""
    events, source, path = table(spark, sf_dir, "events"), fresh_path(spark, "events"), fresh_path(spark, "sketches")
    events.repartition(4, "event_id").write.parquet(source)
    sketch_stream(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source), path)
    found = read_sketches(spark, path)
    exact = column_report(events).select("column", "n_unique")
    middle = found.where("column = 'value'").first()["q50_about"]
    ranks = events.agg(F.avg((F.col("value") < middle).cast("double")).alias("below"), F.avg((F.col("value") <= middle).cast("double")).alias("upto")).first()
    near = F.abs(F.col("distinct_about") - F.col("n_unique")) <= 0.06 * F.col("n_unique")
    median = F.lit(ranks["below"] <= 0.53 and ranks["upto"] >= 0.47)
    joined = found.join(exact, "column")
    return plain(joined.select("column", "rows", "missing", "missing_pct", "low", "high", near.alias("distinct_near"), median.alias("median_near")))


# --- user extensions --------------------------------------------------------------------

if "high_values" not in list_checks():

    @register_check("high_values")
    def _high_values(df, target, profile, context):
        """An example check: rows over the mean of the target, with the profile's row count."""
        mean = df.agg(F.avg(target)).first()[0]
        return df.agg(F.count_if(F.col(target) > F.lit(mean)).alias("high")).withColumn("rows", F.lit(profile.rows))


@register_step("upper_case")
def _upper_case(df, columns=None, **_):
    """An example step."""
    return df.withColumns({c: F.upper(c) for c in columns}), {"columns": ",".join(columns)}


@query(
    "custom_check",
    "select count(*) filter (where value > (select avg(value) from events)) as high, count(*) as rows from events",
)
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return plain(run_checks(df, ["high_values"], target="value")["high_values"])


@query("custom_step", "select event_id, upper(event_type) as event_type from events")
def _(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    return clean(df, [{"action": "upper_case", "columns": ["event_type"]}]).frame


if "high_share" not in list_checks():

    @register_check("high_share", depends_on=["high_values"])
    def high_share(df, target, profile, context):
        return context["high_values"].select((F.col("high") / F.col("rows")).alias("share"))

    @register_check("broken")
    def broken(df, target, profile, context):
        """Fails only while it runs, on a row that no plan shows."""
        return df.agg(F.sum(F.when(F.col("event_id") >= 0, F.raise_error("broken on purpose").cast("int"))).alias("n"))

    @register_check("after_broken", depends_on=["broken"])
    def after_broken(df, target, profile, context):
        return context["broken"]


EVENT_TOTALS = """
with e as (select event_id, event_type, value from events),
n as (select count(*) as n from e), d as (select count(*) as k from (select distinct * from e)),
m as (select sum((event_id is null)::int + (event_type is null)::int + (value is null)::int) as m from e)
"""
EVENT_SUMMARY = [
    "select 'summary' as section, 'dataset' as item, 'rows' as metric, n::double as num, null as txt from n",
    "select 'summary', 'dataset', 'cols', 3::double, null",
    "select 'summary', 'dataset', 'missing_pct', round(100.0 * m / (3 * n), 2)::double, null from n, m",
    "select 'summary', 'dataset', 'duplicates', (n - k)::double, null from n, d",
    "select 'summary', 'dataset', 'duplicates_pct', round(100.0 * (n - k) / n, 2)::double, null from n, d",
    "select 'summary', 'dataset', 'target', null::double, 'value'",
]
HIGH = "select count(*) filter (where value > (select avg(value) from events)) as high, count(*) as n from events"


def event_report(spark, sf_dir, checks):
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return full_report(df, "value", row_key=["event_id"], checks=checks)


@query(
    "report_custom_check",
    EVENT_TOTALS
    + " union all ".join(
        [
            *EVENT_SUMMARY,
            f"select 'high_values', 'dataset', 'high', high::double, null from ({HIGH})",
            f"select 'high_values', 'dataset', 'rows', n::double, null from ({HIGH})",
            f"select 'high_share', 'dataset', 'share', round(high / n, 4)::double, null from ({HIGH})",
        ]
    ),
)
def _(spark, sf_dir):
    """Registered checks are sections of the report; one gets the result of the other."""
    return plain(event_report(spark, sf_dir, ["high_share"]).where("section in ('summary', 'high_values', 'high_share')"), 4)


@query(
    "report_with_failure",
    EVENT_TOTALS
    + " union all ".join(
        [
            *EVENT_SUMMARY,
            "select 'broken', 'dataset', 'error', null::double, 'broken on purpose' from n where n > 0",
            "select 'after_broken', 'dataset', 'error', null::double, 'needs broken: broken on purpose' from n where n > 0",
        ]
    ),
)
def _(spark, sf_dir):
    """A check that fails while it runs is one row of its section, as is what depends on it; all else is there."""
    rows = event_report(spark, sf_dir, ["after_broken"]).where("metric = 'error' or section = 'summary'")
    text = F.regexp_replace("txt", "^(needs broken: )?.*(broken on purpose).*$", "$1$2")
    return plain(rows.withColumn("txt", F.when(F.col("metric") == "error", text).otherwise(F.col("txt"))), 4)
