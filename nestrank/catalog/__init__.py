"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

MODULES = ("text_queries", "score_queries", "data_queries", "log_queries", "page_queries", "store_queries", "many_queries")


def _load():
    from importlib import import_module, util

    for name in MODULES:
        if util.find_spec(f"{__name__}.{name}"):
            import_module(f"{__name__}.{name}")
    from nestrank.catalog import registry

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().ORACLES)
