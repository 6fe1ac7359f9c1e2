"""The queries of this subpackage, collected from its modules."""

from __future__ import annotations

from simweave.llm import (
    queries_encoding,
    queries_graph,
    queries_near,
    queries_quality,
    queries_spans,
    queries_split,
    queries_text,
    queries_tokens,
)

_MODULES = (
    queries_split,
    queries_graph,
    queries_near,
    queries_spans,
    queries_encoding,
    queries_text,
    queries_tokens,
    queries_quality,
)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
