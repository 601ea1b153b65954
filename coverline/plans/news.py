"""Registered queries of the news jobs and the SQL they are held against."""

from __future__ import annotations

from coverline.plans import checks, counts, flows, merges, settled, texts  # noqa: F401  they enter their queries
from coverline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
