"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from millrace.plans import job_queries, model_queries, more_queries, page_queries, signal_queries, store_queries

_PARTS = (signal_queries, page_queries, job_queries, more_queries, store_queries, model_queries)
QUERIES: dict = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
SQL: dict = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
