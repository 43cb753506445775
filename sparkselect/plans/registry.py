"""The query registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, when exact, its DuckDB text."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    """Import every catalog module so that all queries are registered."""
    from sparkselect.plans import catalog, catalog_curves, catalog_models, catalog_prep, catalog_profile, catalog_temporal, catalog_trees  # noqa: F401
    return QUERIES, ORACLE
