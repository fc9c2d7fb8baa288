"""Names of queries with what runs them and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from glosspark.session import reach

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, ops: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the ids of the operators it shows."""

    def keep(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach(spark)
            return f(spark, sf_dir)

        QUERIES[name], OPERATORS[name] = run, tuple(ops.split())
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep
