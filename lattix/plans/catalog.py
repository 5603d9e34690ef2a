"""All registered queries and their SQL."""

from __future__ import annotations

from lattix.plans import build_queries, graph_queries, more_queries, source_queries

_MODULES = [graph_queries, build_queries, more_queries, source_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
