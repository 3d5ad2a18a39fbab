"""Queries over the test tables, each with its SQL where SQL can express it."""

from . import chat, models, retrieval, relational, tabular, text  # noqa: F401  they register their queries
from .registry import oracle_sql, queries
from .retrieval import flagship

__all__ = ["flagship", "oracle_sql", "queries"]
