"""All queries of the core library and their SQL."""

from __future__ import annotations

from tidemark.plans import capture_queries, content_queries, data_queries, report_queries

QUERIES = {**capture_queries.QUERIES, **content_queries.QUERIES, **data_queries.QUERIES, **report_queries.QUERIES}
SQL = {**capture_queries.SQL, **content_queries.SQL, **data_queries.SQL, **report_queries.SQL}
