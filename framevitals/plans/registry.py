"""User extensions: named checks over a frame and named cleaning steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame

from framevitals.functions import columns as C
from framevitals.operators.profile import Profile, profile
from framevitals.plans.schedule import Task, run_graph
from framevitals.sources.scratch import checkpointed

Check = Callable[..., DataFrame]
Step = Callable[..., tuple[DataFrame, dict[str, Any]]]

_CHECKS: dict[str, Check] = {}
_NEEDS: dict[str, tuple[str, ...]] = {}
_STEPS: dict[str, Step] = {}


def register_check(name: str, depends_on: Iterable[str] = ()) -> Callable[[Check], Check]:
    """Add ``check(df, target, profile, context) -> DataFrame``; a name can be taken only once.

    ``context`` holds the results of the checks it depends on.
    """

    if not name:
        raise ValueError("a check needs a name")

    def add(check: Check) -> Check:
        if name in _CHECKS and _CHECKS[name] is not check:
            raise ValueError(f"check '{name}' is already registered")
        _CHECKS[name] = check
        _NEEDS[name] = tuple(depends_on)
        return check

    return add


def register_step(name: str) -> Callable[[Step], Step]:
    """Add ``step(df, **params) -> (df, log)``; a later registration replaces an earlier one."""

    if not name:
        raise ValueError("a step needs a name")

    def add(step: Step) -> Step:
        _STEPS[name] = step
        return step

    return add


def get_check(name: str) -> Check:
    if name not in _CHECKS:
        raise ValueError(f"unknown check '{name}'")
    return _CHECKS[name]


def get_step(name: str) -> Step | None:
    return _STEPS.get(name)


def list_checks() -> list[str]:
    return list(_CHECKS)


def list_steps() -> list[str]:
    return list(_STEPS)


def with_needs(names: Iterable[str]) -> list[str]:
    """``names`` and all checks that they depend on, dependencies first."""
    found: dict[str, None] = {}

    def visit(name: str, above: tuple[str, ...]) -> None:
        get_check(name)
        if name in above:
            raise ValueError(f"checks depend on each other: {' -> '.join((*above, name))}")
        for need in _NEEDS.get(name, ()):
            visit(need, (*above, name))
        found.setdefault(name)

    for name in names:
        visit(name, ())
    return list(found)


def check_task(name: str, df: DataFrame, target: str | None, shared: Callable[[dict], Profile], more: tuple[str, ...] = ()) -> Task:
    """A check as a task. Its result is stored before the task ends, so that errors of running jobs are its own."""
    check = get_check(name)

    def make(known: dict[str, Any]) -> DataFrame:
        return checkpointed(check(df, target, shared(known), {n: f for n, f in known.items() if n not in more}))

    return Task(make, (*more, *_NEEDS.get(name, ())))


def run_checks(
    df: DataFrame, names: Iterable[str], target: str | None = None, shared: Profile | None = None
) -> dict[str, DataFrame]:
    """Run checks, and those they depend on, over one shared profile; independent ones at the same time.

    A check sees in ``context`` the checks it depends on and those named before it without an error. One that fails, in its plan
    or while it runs, yields a one-row frame with an ``error`` column, and the others go on.
    """
    names = with_needs(names)
    shared = profile(df) if shared is None else shared
    tasks: dict[str, Task] = {}
    for at, name in enumerate(names):
        one = check_task(name, df, target, lambda _: shared)
        own = set(one.depends_on)
        # earlier checks may be read from the context without being declared: wait for them, but do without them if they failed
        before = tuple(n for n in names[:at] if n not in own) if _reads_context(name) else ()
        tasks[name] = Task(_guarded(one, own), (*one.depends_on, *before), tolerant=True)
    found = run_graph(df.sparkSession, tasks)
    failed = {n: C.small_frame(df.sparkSession, "error string", [(o.error,)]) for n, o in found.items() if o.error is not None}
    return {n: failed.get(n, o.value) for n, o in found.items()}


def _guarded(task: Task, own: set[str]) -> Callable[[dict[str, Any]], DataFrame]:
    def make(known: dict[str, Any]) -> DataFrame:
        for need in own:
            if need not in known:
                raise RuntimeError(f"needs {need}, which failed")
        return task.make(known)

    return make


def _reads_context(name: str) -> bool:
    """Checks that declare nothing may read any earlier result."""
    return not _NEEDS.get(name)
