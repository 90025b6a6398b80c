"""Fits over all rows of large cells: rows stay where they are, weights travel, a pass adds up sums over all rows.

A fit is a generator that yields the weights it wants judged and is sent the sums. The fits of all cells move through
the same passes; a fit that has ended leaves them. The driver holds weights and sums, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from likeness.functions.vectors import vector_sum

TASK_BYTES = 64 << 20    # of vectors in a task, unless that leaves cores idle
MAX_TASKS = 100_000
SUMS = "key int, s array<double>"


def held(rows: DataFrame, nbytes: int) -> DataFrame:
    """``rows`` of about ``nbytes`` kept in as many tasks as there are cores, or more where those would grow too large."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-nbytes // TASK_BYTES))
    return rows.repartition(min(tasks, MAX_TASKS)).persist(StorageLevel.MEMORY_AND_DISK)


def by_cell(table: pa.Table, by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of every cell in a batch."""
    for cell, index in table.select(by).to_pandas().groupby(by, sort=False).indices.items():
        yield cell if isinstance(cell, tuple) else (cell,), table.take(pa.array(index, pa.int64()))


def add_up(rows: DataFrame, body: Callable[[pa.Table], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """One pass: ``body`` yields (key, array) for a batch of rows; the sum per key, first inside every task."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, s in body(pa.Table.from_batches([batch])) if batch.num_rows else ():
                total[key] = total[key] + s if key in total else s
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))],
                                         names=["key", "s"])

    found = rows.mapInArrow(run, SUMS).groupBy("key").agg(vector_sum("s").alias("s")).toArrow()
    return {k: np.asarray(s) for k, s in zip(found["key"].to_pylist(), found["s"].to_pylist())}


def run_fits(fits: list[Generator], judge: Callable[[dict], dict]) -> list:
    """Drive all fits at once: ``judge`` gets what the open ones ask for and returns what each is sent."""
    found, asked = [None] * len(fits), {}

    def move(i: int, sent) -> None:
        try:
            asked[i] = fits[i].send(sent)
        except StopIteration as end:
            asked.pop(i, None)
            found[i] = end.value

    for i in range(len(fits)):
        move(i, None)
    while asked:
        for i, answer in judge(dict(asked)).items():
            move(i, answer)
    return found
