"""All queries of the core library, by name."""

from __future__ import annotations

from tesserine.plans import change_queries, engine_queries, index_queries, search_queries

MODULES = [search_queries, index_queries, engine_queries, change_queries]

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
