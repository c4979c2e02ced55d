"""Reading tables from CSV and writing results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loofold.functions.scalars import quoted

BROADCAST_PIECES = 200_000
"""Up to this many file pieces, some 20 MB, their offsets go to every executor."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with a header row. Give a schema for large files: inferring costs a pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


PIECE = ("__file", "__block")


def _numbered(pieces: DataFrame, names: list[str], key: str) -> DataFrame:
    """Rows with their place within their piece of file, counted while they are read.

    A task reads a piece from its start to its end, one after another, and nothing that is done
    with the result moves before the count.
    """
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(n).dictionary_encode(), batch.column(n + 1).to_numpy()
            code = file.indices.to_numpy()
            cuts = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(block) != 0)))
            at = np.arange(batch.num_rows)
            for begin, end in zip(cuts, np.append(cuts[1:], batch.num_rows), strict=True):
                piece = file.dictionary[int(code[begin])].as_py(), int(block[begin])
                before = seen.get(piece, 0)
                at[begin:end] += before - begin
                seen[piece] = before + int(end - begin)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], names=[key, *names, *PIECE])

    return pieces.mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *pieces.schema.fields]))


def _offsets(pieces: DataFrame, by_file: bool) -> DataFrame:
    """Rows before each piece, in its file or in all files by name; no column of the files is read.

    One row per piece of file, about 8,000 per terabyte: they add up on the driver.
    """
    offset, last, offsets = 0, None, []
    for file, block, n in sorted(tuple(r) for r in pieces.groupBy(*PIECE).count().collect()):
        offset = 0 if by_file and file != last else offset
        offsets.append((file, block, offset))
        offset, last = offset + n, file
    starts = pieces.sparkSession.createDataFrame(offsets, "__file string, __block bigint, __offset bigint")
    return F.broadcast(starts) if len(offsets) <= BROADCAST_PIECES else starts


def with_row_id(df: DataFrame, key: str = "row_id", file: str | None = None) -> DataFrame:
    """Adds the position 0, 1, 2 .. of each row in a keyless scan of files, and writes nothing.

    One pass counts the rows of each piece of file and a second numbers them as they are read. With
    ``file``, positions begin anew in each file, whose path is that column. ``df`` is the scan
    itself. If a later read splits the files in other places than the count did, the job fails and
    gives no wrong number.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    pieces = df.select(
        *[F.col(quoted(c)).alias(n) for n, c in zip(names, df.columns, strict=True)],
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
    )
    numbered = _numbered(pieces, names, "__at").join(_offsets(pieces, file is not None), list(PIECE), "left")
    place = F.coalesce("__offset", F.raise_error("files were split in other places than when their rows were counted").cast("long"))
    return numbered.select(
        *([F.col("__file").alias(file)] if file else []),
        (place + F.col("__at")).alias(key),
        *[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)],
    )


def last_rows(spark: SparkSession, path: str, n: int, schema: T.StructType | str | None = None) -> list[Row]:
    """The last ``n`` rows of a CSV table, from the ends of the last files only.

    Spark looks into the pieces of a file from the last one on until it has enough rows.
    """
    table = read_csv(spark, path, schema)
    found: list[Row] = []
    for file in sorted(table.inputFiles(), reverse=True):
        found = read_csv(spark, file, table.schema).tail(n - len(found)) + found
        if len(found) >= n:
            break
    return found


def literal_table(spark: SparkSession, columns: dict[str, list], schema: str | None = None) -> DataFrame:
    """A small table from lists of values."""
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, schema or list(columns))


def write_predictions(df: DataFrame, path: str) -> None:
    """CSV files with a header and no index column."""
    df.write.csv(path, header=True)
