"""Registry of the engine's queries."""

from __future__ import annotations

from graphloom.plans import assembly_queries, context_queries, controller_queries, graph_queries, metric_queries, record_queries, resolution_queries, runtime_queries, scoring_queries, source_queries, state_queries, text_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (text_queries, metric_queries, graph_queries, state_queries, context_queries, record_queries, runtime_queries, controller_queries, resolution_queries, assembly_queries, scoring_queries, source_queries):
    QUERIES |= _module.R.queries
    SQL |= _module.R.sql
