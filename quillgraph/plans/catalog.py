"""Registered queries of the graph engine and their DuckDB equivalents."""

from __future__ import annotations

from . import graph_queries, lab_queries, workflow_queries

QUERIES: dict = {**graph_queries.QUERIES, **lab_queries.QUERIES, **workflow_queries.QUERIES}
ORACLE: dict = {**graph_queries.ORACLE, **lab_queries.ORACLE, **workflow_queries.ORACLE}
