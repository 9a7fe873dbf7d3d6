"""All queries of the library over the driver tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .plans.views import Views, with_views

FLAGSHIP = "f3_representative_copies"
MODULES = ("summary_queries", "tree_queries", "network_queries", "label_queries", "deep_queries", "event_queries", "rest_queries", "shape_queries", "partner_queries", "name_queries", "study_queries")

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of `Views` as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
