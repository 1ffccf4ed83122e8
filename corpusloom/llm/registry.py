"""Queries and SQL of this subpackage."""
from __future__ import annotations

from . import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE)
