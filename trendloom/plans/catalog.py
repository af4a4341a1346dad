"""Every query of the engine by name, with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from trendloom.plans import queries_relational, queries_text, queries_topics, queries_trends, queries_vectors
from trendloom.plans import queries_run  # after those that it refers to
from trendloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_relational", "queries_run", "queries_text", "queries_topics", "queries_trends", "queries_vectors"]
