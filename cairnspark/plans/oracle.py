"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from . import analytics_queries, rust_queries, search_queries

ORACLES: dict[str, str] = {**search_queries.ORACLES, **analytics_queries.ORACLES, **rust_queries.ORACLES}
