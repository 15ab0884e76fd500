"""The corpus queries."""

from __future__ import annotations

from tableprobe.llm import query_alignment, query_decontamination, query_html, query_ids, query_language, query_lines, query_mixing, query_near_duplicates, query_periods, query_quality, query_repeats, query_secrets, query_signatures  # noqa: F401
from tableprobe.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
