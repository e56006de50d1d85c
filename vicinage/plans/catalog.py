"""Loads every module that registers queries."""

from __future__ import annotations

from . import document_queries, frequency_queries, set_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
