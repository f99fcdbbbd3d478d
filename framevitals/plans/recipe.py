"""Cleaning recipes: ordered steps folded into one lazy plan, with a log row per fact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from framevitals.functions import columns as C
from framevitals.operators import cleaning
from framevitals.plans.registry import get_step, register_step
from framevitals.sources.scratch import checkpointed

LOG_SCHEMA = "step_no int, action string, status string, metric string, value string, error string"
READS_DATA = {"smart_impute", "cast_schema", "remove_duplicates"}


@register_step("drop_columns")
def _drop(df: DataFrame, columns: Sequence[str] | None = None, **_: Any):
    gone = [c for c in (columns or []) if c in df.columns]
    return cleaning.drop_columns(df, columns), {"dropped": ",".join(gone), "count": len(gone)}


@register_step("remove_duplicates")
def _dedupe(df: DataFrame, columns=None, subset=None, keep="first", order_by=(), **_: Any):
    found = cleaning.dedupe_log(df, subset, keep).first()
    log = {k: found[k] for k in ("duplicates_removed", "status", "columns_affected")}
    if found["duplicates_removed"] == 0:
        return df, log
    return cleaning.remove_duplicates(df, subset, keep, order_by), log


@register_step("smart_impute")
def _impute(df: DataFrame, columns=None, method: str | None = "auto", constant_value: Any = 0, **_: Any):
    if not columns:
        raise ValueError("smart_impute needs a column")
    if len(columns) > 1:
        raise ValueError("smart_impute takes one column a step")
    return cleaning.impute(df, columns[0], method or "auto", constant_value)


@register_step("cast_schema")
def _cast(df: DataFrame, columns=None, method: str | None = "auto", **_: Any):
    if not columns:
        raise ValueError("cast_schema needs a column")
    if len(columns) > 1:
        raise ValueError("cast_schema takes one column a step")
    return cleaning.cast_column(df, columns[0], method or "auto")


@dataclass
class Cleaned:
    frame: DataFrame
    log: DataFrame
    declared: dict[str, str] = field(default_factory=dict)


def clean(df: DataFrame, steps: Sequence[dict[str, Any]], declared: dict[str, str] | None = None) -> Cleaned:
    """Run ``steps`` ({'action', 'columns', 'method', ...}) in order over ``df``.

    Blank text is NULL before every step. An unknown action is skipped, a failing one leaves
    the data as it was; both are logged. ``declared`` remembers the types of successful
    casts. After a row shuffle that later steps read from, the frame is checkpointed once,
    so their statistics do not repeat the shuffle.
    """
    memory = dict(declared or {})
    rows: list[tuple] = []
    current = C.blank_to_null(df)
    for no, step in enumerate(steps, 1):
        action = step.get("action")
        params = {k: v for k, v in step.items() if k != "action"}
        run = get_step(action)
        if run is None:
            rows.append((no, action, "skipped", "reason", "no such step", None))
            continue
        try:
            after, log = run(current, **params)
        except Exception as error:  # logged, not raised: the data stays as it was
            rows.append((no, action, "failed", None, None, str(error)))
            continue
        if "error" in log:
            rows.append((no, action, "failed", None, None, str(log["error"])))
            continue
        rows += [(no, action, "done", k, str(v), None) for k, v in log.items()]
        if action == "cast_schema":
            memory[log["column"]] = log["new_type"]
        later = any(s.get("action") in READS_DATA for s in steps[no:])
        if action == "remove_duplicates" and after is not current and later:
            after = checkpointed(after)
        current = after if action in ("drop_columns", *READS_DATA) else C.blank_to_null(after)
    return Cleaned(current, C.small_frame(df.sparkSession, LOG_SCHEMA, rows), memory)
