"""All queries of the library; importing the modules registers them."""

from __future__ import annotations

from . import code_queries, extra_queries, line_queries, more_queries, project_queries, report_queries, session_queries, source_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
