"""The registered queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of ``tessera.plans`` that register queries.
MODULES = ["snapshot_queries", "relational_queries", "scalar_queries", "retrieval_queries", "catalog_queries", "telemetry_queries", "stream_queries", "more_retrieval_queries", "ranking_queries"]


def core_queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in import_module(f"tessera.plans.{m}").QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tessera.plans.{m}").SQL.items()}
