"""All queries of the library by name, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.runtime import prepare

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: put a (spark, sf_dir) function into the registry."""

    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return put


#: The modules whose queries count.
_MODULES = ("text_queries", "dataset_queries", "eval_queries", "match_queries", "more_queries", "composed_queries", "model_queries")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"quarrymill.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame."""
    _load()
    return {k: _ready(f) for k, f in _QUERIES.items()}


def _ready(function: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    """name -> DuckDB SQL."""
    _load()
    return dict(_SQL)
