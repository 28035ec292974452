"""Named queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

from . import graph_queries, model_queries, read_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (read_queries, graph_queries, model_queries):
    QUERIES |= _module.book.queries
    ORACLES |= _module.book.oracles
