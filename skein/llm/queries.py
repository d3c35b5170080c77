"""All queries of the subpackage, by name, with their SQL."""

from __future__ import annotations

from skein.llm import conversation_queries, defect_queries, leak_queries, mixing_queries, overlap_queries, packing_queries, split_queries, truncation_queries

_MODULES = [conversation_queries, packing_queries, defect_queries, split_queries, overlap_queries, leak_queries, mixing_queries, truncation_queries]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
