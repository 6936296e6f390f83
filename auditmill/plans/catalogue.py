"""All queries of the engine by name, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from auditmill.plans import feed_queries, fetch_queries, markup_queries, page_queries, parse_queries, site_queries, store_queries, text_queries, url_queries  # noqa: F401  they register themselves
from auditmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
