"""All registered queries and their SQL."""

from __future__ import annotations

from . import operator_queries, text_queries, tree_queries  # noqa: F401  they fill the table
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
