"""Registration of queries next to their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "panel", "knowledge", "outcomes", "audits", "universe", "metrics", "forecasts", "models",
    "stores", "learning",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"catalog.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
