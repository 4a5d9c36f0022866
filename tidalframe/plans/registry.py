"""All queries of the operators, and their SQL."""

from __future__ import annotations

from tidalframe.plans import composed_queries, document_queries, matrix_queries, report_queries, segment_queries, signal_queries, store_queries, training_queries

_MODULES = (signal_queries, segment_queries, matrix_queries, document_queries, store_queries, training_queries, report_queries)

QUERIES = {name: query for m in (*_MODULES, composed_queries) for name, query in m.QUERIES.items()} | training_queries.COMPOSED
SQL = {name: text for m in (*_MODULES, composed_queries) for name, text in m.SQL.items()}
