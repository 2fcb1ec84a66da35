"""Registry of the queries: name -> Spark callable, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colophon.plans.bindings import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_TABLES: dict[tuple[str, str], Tables] = {}


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``uses`` names the bound views the SQL reads."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(_tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(uses.split(), sql)
        return fn

    return register
