"""Registry of the audit engine's queries and of the SQL that restates them."""

from __future__ import annotations

from . import audits_queries, report_queries, site_queries, urls_text

_PARTS = (urls_text, site_queries, report_queries, audits_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
