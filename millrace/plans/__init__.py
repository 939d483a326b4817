"""Composite plans and the catalog of registered queries."""


def _load():
    from millrace.plans import (  # noqa: F401
        queries_basic,
        queries_models,
        queries_order,
        queries_prepare,
    )
    from millrace.plans.catalog import QUERIES, SQL

    return QUERIES, SQL


def all_queries():
    return dict(_load()[0])


def all_sql():
    return dict(_load()[1])
