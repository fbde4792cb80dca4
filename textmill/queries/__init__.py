"""Queries of the engine's operators over the given tables, each with SQL where SQL can express it."""

from __future__ import annotations

from textmill.queries import columns, corpus, events, keyed, pages, retrieval, sources, stats

_MODULES = (sources, corpus, pages, retrieval, keyed, stats, columns, events)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
