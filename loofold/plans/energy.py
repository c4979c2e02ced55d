"""Energy readings per run, from logs and profiler summaries, joined to run results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loofold.functions.scalars import quoted, to_kwh
from loofold.sources.tables import with_row_id

# Where a profiler summary states the energy of the processor package.
MARKER = "Package_0"
MARKER_ROW = 2
MARKER_CELL = 3

#: A cell and the comma behind it; quotes keep their commas, a lone quote is a letter like any other.
CELL = r'((?:[^,"]|"[^"]*+"|")*+),'


def cells_of(line: Column) -> Column:
    """The cells of a ragged line as it stands, quotes included; an empty line has one empty cell."""
    return F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1))


def number_of(cell: Column) -> Column:
    """The number that a cell holds, else null."""
    return cell.try_cast("double")


def read_emissions(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Log of energy readings; a ``source`` column names the file of each row."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumn("source", F.col("_metadata.file_path"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of profiler summaries: source, line_no, cells. Empty lines count and are kept.

    Files are split like any text, so a report of any size is read by many tasks.
    """
    lines = with_row_id(spark.read.text(path), "line_no", "source")
    return lines.select("source", "line_no", cells_of(F.col("value")).alias("cells"))


def last_reading(readings: DataFrame, value: str, ts: str, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Newest reading of each run by timestamp, one partial aggregate per task.

    Of readings with one timestamp the largest counts: what is measured only grows.
    """
    newest = F.max(F.struct(F.col(quoted(ts)).alias("ts"), F.col(quoted(value)).alias("value")))
    return (
        readings.where(F.col(quoted(ts)).isNotNull())
        .groupBy(*map(quoted, by))
        .agg(newest.alias("__newest"))
        .select(*map(quoted, by), F.col("__newest.value").alias(value), F.col("__newest.ts").alias(ts))
    )


def nth_match(rows: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """The n-th row of each group in key order.

    The row number is limited first, so each task hands on n rows per group at most,
    however many one group holds.
    """
    number = F.row_number().over(Window.partitionBy(*map(quoted, by)).orderBy(quoted(order)))
    return rows.withColumn("__n", number).where(F.col("__n") <= n).where(F.col("__n") == n).drop("__n")


def marker_energy(
    lines: DataFrame,
    by: Sequence[str] = ("source",),
    marker: str = MARKER,
    row: int = MARKER_ROW,
    cell: int = MARKER_CELL,
) -> DataFrame:
    """Energy in mJ per report: given cell of the given marker row, 0 where there is none."""
    marked = lines.where(F.exists("cells", lambda c: c.contains(marker)))
    value = number_of(F.try_element_at("cells", F.lit(cell)))
    found = nth_match(marked, by, "line_no", row).select(*by, value.alias("energy_mj"))
    everyone = lines.select(*by).distinct()
    return everyone.join(found, list(by), "left").withColumn(
        "energy_mj", F.coalesce("energy_mj", F.lit(0.0))
    )


def attach_energy(
    runs: DataFrame, readings: DataFrame, by: Sequence[str], value: str, unit: str | None = None
) -> DataFrame:
    """Adds ``energy_kwh`` to every row of a run. ``readings`` has one row per run.

    No side is forced to broadcast: Spark knows both sizes when it gets there.
    """
    kwh = to_kwh(F.col(quoted(value)), F.col(unit) if unit else F.lit("kWh"))
    per_run = readings.select(*map(quoted, by), kwh.alias("energy_kwh"))
    return runs.drop("energy_kwh").join(per_run, list(by), "left")
