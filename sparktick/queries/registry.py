"""Query registry and helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 8


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a query; double columns are rounded so that both engines' last bits do not matter."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(*[
        F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema
    ])


def r(expr: str, name: str, digits: int = DIGITS) -> str:
    """SQL: rounded expression, without negative zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rs(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(r(n, n, digits) for n in names)
