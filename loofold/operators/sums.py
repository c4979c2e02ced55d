"""Sums of long vectors over all rows of a table, added up in levels.

Each task holds one vector of totals and hands it on as a few packed rows, one per stretch of
``PACKED`` numbers. Stretches of the same number meet first within 1 of ``ROOTS`` shares of the tasks,
then all together, so that no task adds more than a small part and the driver
gets the vector once. A task streams its rows and holds one total per stretch that it is dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = 1 << 16
"""Numbers of a packed row."""
ROOTS = 64
PACKS = "root int, stretch int, total binary"


def _packs(root: list[int], stretch: list[int], totals: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(root, pa.int32()), pa.array(stretch, pa.int32()), pa.array([t.tobytes() for t in totals], pa.binary())],
        names=["root", "stretch", "total"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for root, stretch, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            more = np.frombuffer(total)
            key = root, stretch
            held[key] = held[key] + more if key in held else more
    for (root, stretch), total in held.items():
        yield _packs([root], [stretch], [total])


def task_totals(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], width: int) -> DataFrame:
    """One packed row per task and stretch: what ``add(totals, batch)`` adds up over its batches."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                add(totals, batch)
                seen = True
        if seen:
            root = TaskContext.get().partitionId() % ROOTS
            for stretch, begin in enumerate(range(0, width, PACKED)):
                yield _packs([root], [stretch], [totals[begin : begin + PACKED]])

    return rows.mapInArrow(partial, PACKS)


def summed(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], width: int) -> np.ndarray:
    """The vector of ``width`` totals over all rows; zeros of an empty table."""
    shares = task_totals(rows, add, width).repartition("root", "stretch").mapInArrow(_added, PACKS)
    whole = shares.withColumn("root", F.lit(0)).repartition("stretch").mapInArrow(_added, PACKS)
    totals = np.zeros(width)
    for row in whole.toArrow().to_pylist():
        begin = row["stretch"] * PACKED
        totals[begin : begin + PACKED] = np.frombuffer(row["total"])
    return totals
