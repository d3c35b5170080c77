"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from skein.plans import array_queries, core_queries, gate_queries, nested_queries, record_queries, source_queries, stream_queries, turn_queries

_MODULES = [nested_queries, core_queries, array_queries, turn_queries, gate_queries, record_queries, source_queries, stream_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
