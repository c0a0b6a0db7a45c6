"""Collects the named queries of all plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Plan modules, each with QUERIES and ORACLES.
MODULES = ("kv_plans", "metric_plans", "trace_plans", "scalar_plans", "learn_plans", "more_plans")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for m in MODULES:
        found |= import_module(f"tessera.plans.{m}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for m in MODULES:
        found |= import_module(f"tessera.plans.{m}").ORACLES
    return found
