"""Operators for training-data pipelines; nothing else in the library imports this package."""

from __future__ import annotations

from gristmill.llm.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
