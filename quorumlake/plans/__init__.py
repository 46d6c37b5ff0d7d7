"""Registered queries over the given tables."""

from . import extract_queries, graph_queries, memory_queries, more_queries, quality_queries, record_queries, store_queries, table_queries, term_queries  # noqa: F401
from .registry import QUERIES, SQL


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
