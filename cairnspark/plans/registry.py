"""Registered queries over the driver's tables."""

from __future__ import annotations

from . import analytics_queries, rust_queries, search_queries

QUERIES = {**search_queries.QUERIES, **analytics_queries.QUERIES, **rust_queries.QUERIES}
