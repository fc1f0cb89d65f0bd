"""Tokenised documents and running totals over task outputs, shared by the token operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, text_chunks


def token_runs(batches, path: str, end_id: int, size: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, token ids, offsets) for runs of rows; each document's ids end with ``end_id``."""
    enc = encoder(path)
    for ids, data, off in text_chunks(batches, size):
        tok, at = enc.encode(data, off)
        out = np.insert(tok, at[1:], end_id)
        yield ids, out, at + np.arange(len(at))


def task_id() -> int:
    return TaskContext.get().partitionId()


def starts(sizes: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``sizes`` with ``name``: the total of ``amount`` in all rows before, by ``order`` (the first column names a task).

    Two passes: totals by task are summed over the tasks (one row a task, so the ordered window over them is bounded
    by the number of tasks), then rows are summed within their task.
    """
    task = order[0]
    totals = sizes.groupBy(task).agg(F.sum(amount).alias("__total"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__total").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(task).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("__within", within).join(before, task).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")
