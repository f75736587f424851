"""Batch analytics for JSON-lines feeds and keyed JSON records on Spark DataFrames."""

from feedloom.session import build_session, configure

__all__ = ["build_session", "configure"]
