"""The catalogue of queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import chunk_queries, field_queries, log_queries, portal_queries, retrieval_queries, source_queries, store_queries, text_queries

FLAGSHIP = "hybrid_search"
QUERIES = {k: v for m in (text_queries, field_queries, source_queries, chunk_queries, retrieval_queries, log_queries, store_queries, portal_queries) for k, v in m.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}
