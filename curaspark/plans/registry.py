"""All registered queries of the engine, with their DuckDB twins."""

from __future__ import annotations

from curaspark.plans import collection_queries, crawl_queries, curate_queries, delivery_queries, evidence_queries, json_queries, lookup_queries, near_queries, need_queries, page_queries, selection_queries, state_queries, status_queries, table_queries

MODULES = [selection_queries, table_queries, collection_queries, curate_queries, status_queries, near_queries, page_queries, json_queries, evidence_queries, need_queries, crawl_queries, delivery_queries, state_queries, lookup_queries]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
