"""All queries of the reference-side operators with their SQL."""

from __future__ import annotations

from quarry.plans import evidence_queries, index_queries, retrieval_queries, search_queries, serving_queries, sql_queries

MODULES = (search_queries, index_queries, retrieval_queries, evidence_queries, serving_queries, sql_queries)


def queries() -> dict:
    return {k: q[0] for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q[1] for m in MODULES for k, q in m.QUERIES.items() if q[1]}
