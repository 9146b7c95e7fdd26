"""All queries of the engine and their SQL: name -> (query, SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "predicates", "joins", "aggregates", "windows", "timeline", "retention", "playlists", "promql", "events", "folds", "supplement", "delivery", "control")


def _all() -> dict:
    out = {}
    for name in MODULES:
        out |= importlib.import_module(f"meridia.plans.{name}").QUERIES
    return out


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _all().items() if sql}


def flagship(spark, sf_dir):
    return queries()["ret1_sliding_window"](spark, sf_dir)


def register(into: dict, sql: str | None = None):
    """Decorator: put a query and its SQL into a module's QUERIES."""

    def take(f):
        into[f.__name__] = (f, sql)
        return f

    return take
