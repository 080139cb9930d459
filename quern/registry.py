"""All queries of the core, by name."""

from __future__ import annotations

from quern import queries_analysis, queries_core_problems, queries_events, queries_graph, queries_items, queries_store, queries_streaming

MODULES = [queries_events, queries_analysis, queries_graph, queries_store, queries_items, queries_streaming, queries_core_problems]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
