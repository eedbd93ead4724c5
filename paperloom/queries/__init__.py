"""Registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from . import document_queries, graph_queries, operator_queries, review_queries, table_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "document_queries", "graph_queries", "operator_queries", "review_queries", "table_queries", "text_queries"]
