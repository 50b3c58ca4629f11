"""All queries on the supplied tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import brief_queries, catalog_queries, classify_queries, diagnostics_queries, folder_queries, inventory_queries, learner_queries, prediction_queries, queue_queries, record_queries, report_queries, semantic_queries, stage_queries, streaming_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (inventory_queries, diagnostics_queries, prediction_queries, text_queries, streaming_queries, classify_queries, report_queries, learner_queries, catalog_queries, stage_queries, queue_queries, folder_queries, brief_queries, record_queries, table_queries, semantic_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
