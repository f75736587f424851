"""All registered queries."""

from feedloom.plans import feed_queries, record_queries, request_queries, source_queries  # noqa: F401
from feedloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
