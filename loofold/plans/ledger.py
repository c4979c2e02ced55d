"""The ledger of runs: schema, appending, merging, result files."""

from __future__ import annotations

import os
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loofold.functions.scalars import fixed_decimals, method_label, run_stamp, seconds_to_ms
from loofold.operators.sets import concatenate
from loofold.plans.energy import attach_energy

LEDGER_SCHEMA = (
    "dataset string, target string, run_ts timestamp, platform string, n_rows bigint, n_features int, "
    "time_s double, time_ms double, mcc double, energy_kwh double, method string, evaluation string, "
    "status string, reason string"
)

# Column names of a results file, in order.
RESULT_COLUMNS = [
    ("Dataset", "dataset"),
    ("Operating system", "platform"),
    ("Column selected", "target"),
    ("LOOCV's time execution (s)", "time_s"),
    ("LOOCV's time execution (ms)", "time_ms"),
    ("MCC", "mcc"),
    ("energy consumption (kWh)", "energy_kwh"),
    ("methodology", "method"),
]


def ledger_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), LEDGER_SCHEMA)


def measured(
    ledger: DataFrame, readings: DataFrame, by: Sequence[str], value: str, unit: str | None = None
) -> DataFrame:
    """Runs with the energy of their reading, and the method label that goes with it."""
    joined = attach_energy(ledger, readings, by, value, unit)
    has_reading = F.col("energy_kwh").isNotNull()
    return joined.withColumn("method", method_label(F.col("platform"), has_reading)).select(*ledger.columns)


def append_ledger(ledger: DataFrame, path: str) -> bool:
    """Appends a batch of runs under ``run_date=``; an empty batch writes nothing."""
    if ledger.isEmpty():
        return False
    dated = ledger.withColumn("run_date", F.to_date("run_ts"))
    dated.write.mode("append").partitionBy("run_date").parquet(path)
    return True


def results_view(ledger: DataFrame) -> DataFrame:
    """Finished runs under the names of a results file, numbers with six decimals."""
    numbers = {"time_s", "time_ms", "mcc", "energy_kwh"}
    return ledger.where("status = 'ok'").select(
        *[
            (fixed_decimals(F.coalesce(c, F.lit(0.0)), 6) if c in numbers else F.col(c)).alias(name)
            for name, c in RESULT_COLUMNS
        ]
    )


def write_results(ledger: DataFrame, folder: str, now: datetime | None = None) -> str | None:
    """CSV results in a new folder named by the time; its path, or None without results."""
    results = results_view(ledger)
    if results.isEmpty():
        return None
    stamp = (now or datetime.now()).strftime("%Y-%m-%d_%Hh-%Mm-%Ss")
    path = os.path.join(folder, f"experiment_{stamp}")
    results.write.csv(path, header=True)
    return path


def read_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Results files as one table. Names are trimmed; an unnamed index column is dropped."""
    frames = []
    for path in paths:
        df = spark.read.csv(path, header=True)
        df = df.toDF(*[c.strip() for c in df.columns])
        frames.append(df.select(*[c for c in df.columns if c and c != "_c0"]))
    return concatenate(frames)


def result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """path and modification time of the files that match a pattern."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("modificationTime").alias("modified"))


def merge_newest(spark: SparkSession, pattern: str, n: int) -> DataFrame:
    """Rows of the n newest results files, the oldest file first."""
    picked = result_files(spark, pattern).orderBy(F.desc("modified"), F.desc("path")).limit(n)
    paths = [r["path"] for r in picked.orderBy("modified", "path").collect()]
    if not paths:
        raise ValueError(f"no results under {pattern}")
    return read_results(spark, paths)


def timed(df: DataFrame, seconds: str = "time_s") -> DataFrame:
    """Adds milliseconds and the stamp of the run."""
    return df.withColumns({"time_ms": seconds_to_ms(F.col(seconds)), "stamp": run_stamp(F.col("run_ts"))})
