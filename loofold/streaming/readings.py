"""Energy logs that grow while runs are going on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_emissions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Stream of readings from log files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def live_energy(readings: DataFrame, value: str, ts: str, by: str = "run_id", *, idle: str) -> DataFrame:
    """Newest reading per run. State is one row per run, dropped once a run has been idle.

    The window groups by the day of the reading, so the watermark can close old state. A
    reading that comes more than ``idle`` after the newest is too late for its window and Spark
    leaves it out; the caller says how late logs may be, and ``late_readings`` counts the rest.
    """
    return (
        readings.withWatermark(ts, idle)
        .groupBy(F.window(ts, "1 day"), by)
        .agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(value).alias("value"))).alias("newest"))
        .select(by, F.col("newest.value").alias(value), F.col("newest.ts").alias(ts))
    )


def late_readings(query: StreamingQuery) -> int:
    """Readings that a finished or running query left out as too late, over its known progress."""
    return sum(
        int(state["numRowsDroppedByWatermark"]) for batch in query.recentProgress for state in batch["stateOperators"]
    )


def store_live_energy(live: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends every update under its batch; a batch that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return (
        live.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
