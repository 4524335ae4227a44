"""The queries of this library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curate_queries, evaluate_queries, select_queries, text_queries

_PARTS = [text_queries, curate_queries, select_queries, evaluate_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}
