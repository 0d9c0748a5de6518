"""Named queries over the domain views, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.sources.tables import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        _QUERIES[name] = build
        if sql is not None:
            _SQL[name] = sql
        return build

    return register


def _load() -> None:
    from talentloom.plans import (  # noqa: F401
        queries_cleaning,
        queries_knowledge,
        queries_matching,
        queries_metrics,
        queries_scoring,
        queries_storage,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build: Callable[[Tables], DataFrame]):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
