"""All registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import activity_queries, people_queries, retrieval_queries, scalar_queries

MODULES = (retrieval_queries, scalar_queries, people_queries, activity_queries)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
