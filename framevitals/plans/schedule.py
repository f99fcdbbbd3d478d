"""Run named tasks as a dependency graph of concurrent Spark jobs; what fails stays in its own place.

A task starts as soon as all it depends on has ended. Its function does its Spark work before it returns, so that an error
of a running job is caught like one of the plan. A task whose dependency failed is not run, unless it is ``tolerant``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

JOBS = 6
LONGEST = 500


@dataclass(frozen=True)
class Task:
    """``make`` gets the results of ``depends_on`` by name (of a tolerant task: those that there are)."""

    make: Callable[[dict[str, Any]], Any]
    depends_on: tuple[str, ...] = ()
    tolerant: bool = False


@dataclass(frozen=True)
class Outcome:
    value: Any = None
    error: str | None = None


def message(error: BaseException) -> str:
    """The first line of an error, as a report shows it."""
    lines = str(error).strip().splitlines()
    return (lines[0] if lines else type(error).__name__)[:LONGEST]


def run_graph(spark: SparkSession, tasks: dict[str, Task], jobs: int = JOBS) -> dict[str, Outcome]:
    """Outcome of each task, in the order given. Unknown dependencies and cycles raise a ValueError before anything runs."""
    unknown = sorted({d for t in tasks.values() for d in t.depends_on} - tasks.keys())
    if unknown:
        raise ValueError(f"unknown dependencies: {', '.join(unknown)}")
    graph = TopologicalSorter({name: t.depends_on for name, t in tasks.items()})
    try:
        graph.prepare()
    except CycleError as error:
        raise ValueError(f"checks depend on each other: {' -> '.join(error.args[1])}") from None
    done: dict[str, Outcome] = {}
    running: dict[Future, str] = {}
    inheriting = inheritable_thread_target(spark)  # job group and other local properties of the caller

    def attempt(task: Task, known: dict[str, Any]) -> Outcome:
        try:
            return Outcome(task.make(known))
        except Exception as error:  # kept with the task: one bad check must not hide the others
            return Outcome(error=message(error))

    with ThreadPoolExecutor(max_workers=jobs) as pool:
        while graph.is_active():
            for name in graph.get_ready():
                task = tasks[name]
                failed = [d for d in task.depends_on if done[d].error is not None]
                if failed and not task.tolerant:
                    done[name] = Outcome(error=f"needs {failed[0]}: {done[failed[0]].error}")
                    graph.done(name)
                else:
                    known = {d: done[d].value for d in task.depends_on if done[d].error is None}
                    running[pool.submit(inheriting(attempt), task, known)] = name
            if running:
                for future in wait(running, return_when=FIRST_COMPLETED).done:
                    name = running.pop(future)
                    done[name] = future.result()
                    graph.done(name)
    return {name: done[name] for name in tasks}
