"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import answer_queries, budget_queries, frontier_queries, log_queries, more_queries, outline_queries, search_queries, spot_queries, stage_queries, store_queries, stream_queries, study_queries, table_queries

_MODULES = (search_queries, outline_queries, answer_queries, table_queries, more_queries, stream_queries, study_queries, budget_queries, log_queries, frontier_queries, store_queries, spot_queries, stage_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
