"""All registered queries of the audit engine and their SQL."""

from __future__ import annotations

from . import corpus_queries, source_queries, whole_queries  # noqa: F401  register their queries
from .audit_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
