"""Registered queries over the given tables and the DuckDB SQL of each."""

from __future__ import annotations

from larchgraph.plans import contract_queries, form_queries, graph_queries, source_queries

_PARTS = (graph_queries, contract_queries, source_queries, form_queries)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.Q.items()}
ORACLES: dict[str, str] = {k: s for part in _PARTS for k, s in part.SQL.items()}
