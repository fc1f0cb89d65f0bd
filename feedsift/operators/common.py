"""Small shared helpers. None of them starts a Spark job while a plan is built."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side gets a broadcast hint only when the optimizer's size estimate is at most this many bytes.
BROADCAST_MAX_BYTES = 16 << 20
# Inputs estimated below this many bytes per task slot are dealt over the slots before CPU-heavy work.
SPREAD_BYTES = 32 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (file sizes carried up the plan); reads no data."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` if its estimated size is at most ``max_bytes``, else ``df`` unchanged (AQE may still
    turn the join into a broadcast join by the sizes it measures at run time)."""
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def few_per_row(df: DataFrame, of: DataFrame) -> DataFrame:
    """``broadcast(df)`` if ``of``, for each row of which ``df`` has a bounded number of short rows, is estimated small."""
    return F.broadcast(df) if estimated_bytes(of) <= BROADCAST_MAX_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input round-robin over the cluster's task slots before CPU-heavy per-row work (embedding, HTML
    parsing, model calls), which a single split would otherwise do in one task. Large inputs have many splits and
    stay as they are, so no shuffle of them is added."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if estimated_bytes(df) < want * SPREAD_BYTES else df


def is_missing_path(e: AnalysisException) -> bool:
    """The path doesn't exist; any other failure to read is an error, never an empty table."""
    return (e.getCondition() or "").startswith("PATH_NOT_FOUND")
