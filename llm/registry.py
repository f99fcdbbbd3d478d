"""Queries over the test tables for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm.shipping import shipped

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    import corpus_pipeline

    found: dict[str, Query] = {"pipeline": corpus_pipeline.run}
    for name in MODULES:
        found |= importlib.import_module(f"llm.queries.{name}").QUERIES
    return {name: shipped(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"llm.queries.{name}"), "ORACLE", {})
    return found
