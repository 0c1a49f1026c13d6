"""Registry of runnable queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beliefmill.plans.tables import NOW, Tables, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the named views."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = check_sql(views, sql.replace(":now", f"TIMESTAMP '{NOW}'"))
        return fn

    return wrap


def load_all() -> None:
    from beliefmill.plans import (  # noqa: F401
        admission_queries,
        audit_queries,
        belief_queries,
        consolidation_queries,
        dynamics_queries,
        graph_queries,
        insight_queries,
        learning_queries,
        lifecycle_queries,
        recall_queries,
        stream_queries,
        working_queries,
    )
