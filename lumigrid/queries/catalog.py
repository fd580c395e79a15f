"""The registry of queries for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import facet_queries, join_queries, pixel_queries, raster_queries, rules, scalar_queries, set_queries, source_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (rules, facet_queries, join_queries, set_queries, pixel_queries, scalar_queries, raster_queries, source_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
