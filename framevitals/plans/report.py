"""The full report: every check over one frame, as long (section, item, metric, value) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framevitals.functions import bands
from framevitals.functions import columns as C
from framevitals.operators import labels, leakage, predictive, quality, statistics
from framevitals.operators.profile import Profile, profile, summary
from framevitals.plans import views
from framevitals.plans.checks import STANDARD
from framevitals.plans.registry import check_task, list_checks, with_needs
from framevitals.plans.schedule import Task, run_graph
from framevitals.sources.reports import REPORT_SCHEMA
from framevitals.sources.scratch import checkpointed


def as_rows(frame: DataFrame, section: str, item: str | None = None) -> DataFrame:
    """One row per cell: numbers in ``num``, everything else as text in ``txt``."""
    cells = []
    for f in frame.schema.fields:
        if f.name == item:
            continue
        v = C.ref(f.name)
        if isinstance(f.dataType, T.ArrayType):
            num, txt = F.lit(None).cast("double"), F.array_join(v.cast("array<string>"), ",")
        elif C.family_of(f.dataType) in (C.INTEGER, C.FRACTIONAL):
            num, txt = v.cast("double"), F.lit(None).cast("string")
        else:
            num, txt = F.lit(None).cast("double"), v.cast("string")
        cells.append(F.struct(F.lit(f.name).alias("metric"), num.alias("num"), txt.alias("txt")))
    name = C.ref(item).cast("string") if item else F.lit("dataset")
    return frame.select(F.lit(section).alias("section"), name.alias("item"), F.inline(F.array(*cells)))


def _columns(shared: Profile) -> DataFrame:
    frame = shared.frame()
    return frame.select(
        "position", "column", "type", "family", "rows", "missing",
        bands.percent(F.col("missing"), F.col("rows")).alias("missing_pct"), "n_unique",
    )


def quick_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """First tier: the data-set summary only; usable long before the full report."""
    return as_rows(summary(df, target), "summary")


def full_report(
    df: DataFrame,
    target: str | None = None,
    row_key: list[str] | None = None,
    declared: dict[str, str] | None = None,
    keep_input: bool = False,
    checks: Iterable[str] | None = None,
) -> DataFrame:
    """All checks as (section, item, metric, num, txt).

    ``checks`` are registered checks to include, each a section of its name (default: all but the built-in ones). A check
    that fails, in its plan or while it runs, leaves one row in its section, with metric ``error`` and the message; the others go on.
    Every check scans only its columns. When the input is expensive to recompute and fits the
    executors, ``keep_input`` keeps it there while the checks run. Sections are column-sized and collected, but for
    the classes (of a classification target only) and registered checks, which stay frames of any size.
    """
    data = C.nan_to_null(df)
    if keep_input:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _sections(data, target, row_key, declared or {}, checks)
    finally:
        if keep_input:
            data.unpersist()


def _sections(data: DataFrame, target: str | None, row_key, declared: dict[str, str], checks: Iterable[str] | None) -> DataFrame:
    """Sections as tasks of a dependency graph, so small stages of one fill the gaps of another."""
    name = C.check_target(data, target) if target else None
    wanted = with_needs([c for c in list_checks() if c not in STANDARD] if checks is None else checks)
    tasks: dict[str, Task] = {}

    def section(title: str, make: Callable[[dict], DataFrame], item: str | None = None, needs: tuple[str, ...] = (), tolerant: bool = False) -> None:
        tasks[title] = Task(lambda known: [tuple(r) for r in as_rows(make(known), title, item).collect()], needs, tolerant)

    def power(known: dict) -> DataFrame:
        shared, facts = known["profile"], None
        if shared.column(name).missing == 0:  # then no row is dropped, and the profile's counts hold
            facts = {c.name: {"rows": shared.rows, "missing": c.missing, "n_unique": c.n_unique} for c in shared.columns}
        return predictive.predictive_power(data, name, row_key, facts=facts)

    def classes(known: dict) -> DataFrame | None:
        fact = known["profile"].column(name)
        rows = known["profile"].rows - fact.missing
        if predictive.classifies(C.families(data)[name], fact.n_unique or 0, rows):
            return checkpointed(as_rows(labels.class_distribution(data, name), "class", "label"))
        return None

    def readiness(known: dict) -> DataFrame:
        flagged = any(r[2] == "is_imbalanced" and r[4] == "true" for r in known.get("imbalance", ()))
        return quality.ml_readiness(known["profile"], flagged).drop("penalties")

    tasks["profile"] = Task(lambda _: profile(data))
    tasks["quartiles"] = Task(lambda _: statistics.quartiles_of(data))
    section("leakage", lambda _: leakage.leakage(data, target))
    section("stats_categorical", lambda _: statistics.stats_categorical(data), "column")
    if C.columns_in(data, C.DATETIME):
        section("stats_datetime", lambda _: statistics.stats_datetime(data), "column")
    if name:
        section("imbalance", lambda _: labels.imbalance(data, name))
        tasks["class"] = Task(classes, ("profile",))
        section("predictive_power", power, "feature", ("profile",))
    section("summary", lambda known: _totals(known["profile"], _declared(known, declared), target), None, ("profile",))
    section("column", lambda known: _declared(known, declared), "column", ("profile",))
    section("quality", lambda known: quality.quality(known["profile"]), None, ("profile",))
    tasks["ml_readiness"] = Task(
        lambda known: [tuple(r) for r in as_rows(readiness(known), "ml_readiness").collect()], ("profile", *(["imbalance"] if name else [])), True
    )
    section("suggestion", lambda known: quality.suggestions(known["profile"]), "column", ("profile",))
    section("outliers", lambda known: statistics.outliers(data, quartiles=known["quartiles"]), "column", ("quartiles",))
    section("stats_numeric", lambda known: statistics.stats_numeric(data, quartiles=known["quartiles"]), "column", ("quartiles",))
    for check in wanted:
        if check in tasks:
            raise ValueError(f"'{check}' is the name of a section")
        tasks[check] = check_task(check, data, name, lambda known: known["profile"], ("profile",))

    found = run_graph(data.sparkSession, tasks)
    hidden = {"profile", "quartiles"}
    errors = [(title, "dataset", "error", None, o.error) for title, o in found.items() if o.error is not None and title not in hidden]
    rows = [r for o in found.values() if isinstance(o.value, list) for r in o.value]
    report = C.small_frame(data.sparkSession, REPORT_SCHEMA, rows + errors)
    frames = {title: o.value for title, o in found.items() if isinstance(o.value, DataFrame)}
    for title, frame in frames.items():
        report = report.unionByName(frame if title == "class" else as_rows(frame, title))
    return report


def _declared(known: dict, declared: dict[str, str]) -> DataFrame:
    return views.with_declared_types(_columns(known["profile"]), declared)


def _totals(shared: Profile, columns: DataFrame, target: str | None) -> DataFrame:
    return columns.agg(
        F.lit(shared.rows).cast("bigint").alias("rows"),
        F.lit(len(shared.columns)).alias("cols"),
        bands.percent(F.sum("missing"), F.lit(shared.rows * len(shared.columns))).alias("missing_pct"),
        F.lit(shared.duplicates).cast("bigint").alias("duplicates"),
        bands.percent(F.lit(shared.duplicates), F.lit(shared.rows)).alias("duplicates_pct"),
        F.lit(target).cast("string").alias("target"),
    )
