"""Registered queries: name -> callable, and the SQL that must give equal rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from marketsense.session import configure

Query = Callable[[SparkSession, str], DataFrame]

AREAS = ["prices", "mentions", "sentiment", "quality", "metrics", "models"]


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for area in AREAS:
        found.update(import_module(f"marketsense.catalog.{area}").QUERIES)
    return {name: _configured(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for area in AREAS:
        found.update(import_module(f"marketsense.catalog.{area}").ORACLES)
    return found
