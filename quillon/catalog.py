"""Registry of queries: each with a Spark plan over the benchmark tables and, where SQL can say it, the same as SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Modules that register queries when they are imported.
MODULES = ("tables", "text", "retrieval", "joins", "graph", "audit", "feedback", "governance", "ingest", "events", "more", "store", "index", "readers")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"quillon.plans.queries.{m}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return QUERIES["hybrid_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
