"""Every reference query by name, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from frameloom.plans import catalog_queries, library_queries, sequence_queries, text_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (catalog_queries, library_queries, sequence_queries, text_queries, vector_queries):
    QUERIES |= {name: query for name, (query, _) in _module.CATALOGUE.items()}
    ORACLES |= {name: sql for name, (_, sql) in _module.CATALOGUE.items() if sql}
