"""Registration of a query together with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c, 6) + F.lit(0.0)


def hole(key: str, column: str, every: int = 7) -> Column:
    """The column with a null wherever the key is a multiple of ``every``.

    The tables have no nulls of their own, so fills need some put in; all rows stay.
    """
    return F.when(F.col(key) % every != 0, F.col(column))
