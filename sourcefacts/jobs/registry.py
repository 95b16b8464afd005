"""All registered queries of the code graph, and their oracles."""

from __future__ import annotations

from . import file_queries, graph_queries, resolve_queries, scan_queries

MODULES = (file_queries, scan_queries, resolve_queries, graph_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
