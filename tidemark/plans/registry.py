"""Names of queries, their plans and the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = ("time", "cross", "joins", "portfolio", "evaluation", "serving", "sources", "models")


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name, with the DuckDB SQL for the same rows where SQL can express them."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is there twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the panel engine by name."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-day momentum, its centred rank, a top and bottom five book, and the book's lagged daily return."""
    return queries()["q0_momentum_book"](spark, sf_dir)
