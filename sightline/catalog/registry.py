"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.catalog.views import Views, twin

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def register(name: str, views: str = "", sql: str | None = None):
    """Register ``plan(v: Views) -> DataFrame`` under ``name``; ``sql`` is its twin over ``views``."""

    def keep(plan: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice.")
        QUERIES[name] = lambda spark, folder: plan(Views(spark, folder))
        if sql is not None:
            TWINS[name] = twin(views, sql)
        return plan

    return keep
