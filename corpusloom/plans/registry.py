"""All core queries and their SQL."""
from __future__ import annotations

from . import evaluation_queries, graph_queries, link_queries, text_queries

MODULES = [link_queries, evaluation_queries, graph_queries, text_queries]


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
