"""Operators for the preparation of training text. Nothing else in the library imports this subpackage."""

from specsift.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
