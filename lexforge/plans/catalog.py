"""All queries on the library's operators and the SQL they agree with."""

from __future__ import annotations

from . import relational_queries, retrieval_queries, service_queries, source_queries, structure_queries, text_queries
from .base import Query

MODULES = [text_queries, retrieval_queries, relational_queries, structure_queries, service_queries, source_queries]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.C.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.C.sql.items()}
