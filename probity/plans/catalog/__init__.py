"""Registered queries: one entry per operator, each with its check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from probity.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "text", "features", "anomaly", "fusion", "evaluation", "reports", "labels", "tables", "described", "models", "streams",
]


class Catalog:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, str] = {}

    def add(self, name: str, covers: str, sql: str | None = None):
        """Registers a query under a name with the survey entries it covers."""

        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query registered twice: {name}")
            self.queries[name] = lambda spark, folder: fn(prepare(spark), folder)
            self.covers[name] = covers
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def load() -> Catalog:
    catalog = Catalog()
    for module in MODULES:
        import_module(f"{__name__}.{module}").register(catalog)
    return catalog
