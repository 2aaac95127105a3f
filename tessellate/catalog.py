"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from .plans import aggregates, events, joins, matching, models, projections, rules, scans, sets, simulation, text, windows  # noqa: F401
from .registry import ORACLE, QUERIES, Query

__all__ = ["ORACLE", "QUERIES", "Query"]
