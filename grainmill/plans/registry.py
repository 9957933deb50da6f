"""Registry of queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the tables under `name`, with the SQL that gives the same rows."""

    def keep(plan: Callable[[Tables], DataFrame]):
        if name in PLANS:
            raise ValueError(f"two queries named {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return keep


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        return lambda spark, folder: plan(Tables(spark, folder))

    return {name: bind(plan) for name, plan in PLANS.items()}
