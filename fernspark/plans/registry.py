"""All registered queries of the listings engine, and their SQL."""

from __future__ import annotations

from . import ingest_queries, resolve_queries, search_queries, state_queries, stream_queries

MODULES = [search_queries, ingest_queries, state_queries, resolve_queries, stream_queries]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for m in MODULES for f, sql in m.QUERIES.items() if sql}
