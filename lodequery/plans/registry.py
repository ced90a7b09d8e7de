"""All queries of the core, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from lodequery.plans import graph_queries, log_queries, reference_queries, search_queries, store_queries

MODULES = (search_queries, graph_queries, log_queries, reference_queries, store_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
