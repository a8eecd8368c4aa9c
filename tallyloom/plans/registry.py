"""The core's queries and their DuckDB equivalents, gathered from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("posts", "claims", "measures", "pipeline", "extras", "factcheck")


def query(name: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame as name, with its DuckDB equivalent."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tallyloom.plans.{m}")
