"""Queries over the test tables, one per operator, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def _load() -> None:
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")


def all_queries():
    _load()
    from grainmill.plans.registry import as_callables

    return as_callables()


def all_sql():
    _load()
    from grainmill.plans.registry import SQL

    return dict(SQL)
