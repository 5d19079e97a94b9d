"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import table
from eventloom.shared import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables by name: ``t.orders`` reads orders.parquet."""

    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self._spark, self._root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return table(self._spark, self._root, name)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of Tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, root: f(Tables(spark, root))
        if sql:
            ORACLES[key] = sql
        return f

    return add
