"""Registered queries over the test tables, each with its SQL twin, and composed pipelines."""

from . import analysis_queries, call_queries, market_queries, pipelines, sentiment_queries, suite_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis_queries", "call_queries", "market_queries", "pipelines", "sentiment_queries", "suite_queries", "text_queries"]
