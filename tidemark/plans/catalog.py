"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, period_queries, place_queries, planning_queries, record_queries, report_queries, rule_queries, shape_queries, speech_queries, state_queries, territory_queries, upkeep_queries

MODULES = (archive_queries, period_queries, state_queries, report_queries, record_queries, rule_queries, speech_queries, planning_queries, place_queries, shape_queries, upkeep_queries, territory_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
