"""The registered queries and the DuckDB SQL that they are held against."""

from __future__ import annotations

from eventloom.plans import date_queries, event_queries, run_queries, text_queries  # noqa: F401  they register
from eventloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
