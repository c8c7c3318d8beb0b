"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import context_queries, graph_queries, index_queries, more_queries, text_queries

QUERIES = text_queries.QUERIES | context_queries.QUERIES | graph_queries.QUERIES | more_queries.QUERIES | index_queries.QUERIES
ORACLES = text_queries.ORACLES | context_queries.ORACLES | graph_queries.ORACLES | more_queries.ORACLES | index_queries.ORACLES
end_to_end_context = context_queries.end_to_end_context
