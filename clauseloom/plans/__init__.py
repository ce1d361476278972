"""Registered queries: each runs one operator over the given tables, most with a SQL check."""

from __future__ import annotations

from clauseloom.plans.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
