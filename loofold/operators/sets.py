"""Set operations on tables and on small lists of names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, matched by name; a column some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """Each value once, with the position where it occurs first."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def name_difference(names: Column, without: Column) -> Column:
    return F.array_sort(F.array_except(names, without))


def as_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))
