"""Column statistics, levels, target checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loofold.functions.scalars import nan_to_null, quoted
from loofold.operators.quantiles import EXACT_ROWS, exact_percentiles

PROFILE_SCHEMA = (
    "column string, n bigint, nulls bigint, mean double, std double, std_pop double, "
    "min double, q25 double, q50 double, q75 double, max double"
)


def column_profile(df: DataFrame, columns: Sequence[str], exact_rows: int = EXACT_ROWS) -> DataFrame:
    """One row per numeric column: counts, moments, interpolated quartiles, extremes.

    All moments come from one aggregate over all columns, the quartiles from
    ``exact_percentiles``. The result has as many rows as columns were asked for.
    """
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(columns):
        c = nan_to_null(F.col(quoted(name)).cast("double"))
        parts += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.stddev_pop(c).alias(f"pop{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
        ]
    row = df.agg(*parts).first()
    counts = {name: row[f"n{i}"] for i, name in enumerate(columns)}
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75], counts=counts, exact_rows=exact_rows)
    rows = [
        (
            name, counts[name], row["rows"] - counts[name],
            row[f"mean{i}"], row[f"std{i}"], row[f"pop{i}"],
            row[f"min{i}"], *quartiles[name], row[f"max{i}"],
        )
        for i, name in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the number of missing values of each column; NaN counts as missing."""
    types = dict(df.dtypes)
    missing = {c: F.col(quoted(c)).isNull() for c in columns}
    missing |= {c: missing[c] | F.isnan(quoted(c)) for c in columns if types[c] in ("double", "float")}
    return df.agg(*[F.count_if(missing[c]).alias(c) for c in columns])


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, level, n) for every level of every column, in one shuffle.

    Levels are given as text. Partial counts leave the map side, so a level that holds
    most of the rows costs no more than a rare one.
    """
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("level")) for c in columns
    ]
    return (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .where("e.level IS NOT NULL")
        .groupBy(F.col("e.column").alias("column"), F.col("e.level").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, n_levels): exact number of distinct non-null values per column."""
    return level_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))


def binary_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, n_classes, all_zero_one, is_binary) over the non-null values.

    A column is a binary target when its classes are exactly 0 and 1.
    """
    value = F.col("level").cast("double")
    return (
        level_counts(df, columns)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_classes"),
            F.coalesce(F.bool_and(value.isin(0.0, 1.0)), F.lit(False)).alias("all_zero_one"),
        )
        .withColumn("is_binary", (F.col("n_classes") == 2) & F.col("all_zero_one"))
    )
