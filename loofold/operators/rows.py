"""Row and column picks of a keyed table.

A Spark table has no row order, so "first", "last" and "position" always refer to a
key column. Every function leaves filters where the file scan can take them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import nan_to_null, quoted


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(quoted(key)).limit(n)


def tail_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` rows by key: each task keeps ``n`` rows, one more merges them."""
    return df.orderBy(F.desc(quoted(key))).limit(n)


def slice_rows(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows with ``start <= key < stop``, a range the scan can skip files by."""
    k = F.col(quoted(key))
    return df.where((k >= start) & (k < stop))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(quoted(key)) == F.lit(value))


def rows_at_max(df: DataFrame, column: str) -> DataFrame:
    """All rows that hold the largest value of a column.

    The maximum is a scalar subquery: one number, computed once, compared in the filter.
    """
    peak = df.select(F.max(quoted(column))).scalar()
    return df.where(F.col(quoted(column)) == peak)


def newest(df: DataFrame, ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest rows, given back oldest first."""
    order = [quoted(ts), *map(quoted, tie)]
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def split_target(df: DataFrame, target: str | None = None) -> tuple[list[str], str]:
    """Feature names and target name; without a target the last column is it."""
    target = target or df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"no column named {target!r}")
    return [c for c in df.columns if c != target], target


def numeric_features(df: DataFrame, categorical: Sequence[str], target: str) -> list[str]:
    """All columns that are neither in the categorical role nor the target."""
    skip = {*categorical, target}
    return [c for c in df.columns if c not in skip]


def normalise_types(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Numeric columns to double with NaN as null, categorical whole numbers to int."""
    whole = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)
    columns: list[Column] = []
    for name in df.columns:
        c, kind = F.col(quoted(name)), types[name]
        if name in categorical:
            if kind in ("float", "double"):
                c = nan_to_null(c)
            c = c.cast("int") if kind in whole else c
        elif kind in whole or kind.startswith("decimal"):
            c = nan_to_null(c.cast("double"))
        columns.append(c.alias(name))
    return df.select(*columns)


def table_shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
