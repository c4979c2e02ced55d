"""Queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from loofold.queries import evaluation, linear, prep, profile, rows, runs  # noqa: F401
from loofold.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
