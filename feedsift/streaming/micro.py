"""Structured Streaming forms of the hourly micro-batch jobs.

* R1  — ``trigger(availableNow=True)`` under any scheduler: each run drains
        what arrived since the last checkpoint, then stops.
* R2  — source offsets live in the checkpoint (the batch ``watermarks`` table
        stays for batch runs).
* R4/R11 — ``foreachBatch`` publish: anti join with the ``visited`` table,
        write the output, then append visited markers (mark-after-success).
        Both writes overwrite the partition of (query id, batch id), so a
        replayed batch rewrites instead of duplicating and the anti join
        ignores only its own markers. The query id lives in the checkpoint: a
        lost checkpoint starts a new query, whose batches never touch what an
        earlier query published or marked.
* R5  — TTL dedup: ``withWatermark`` + ``dropDuplicatesWithinWatermark``.
* R6, R7 — keyed change detection and the newest version over a sliding
        look-back: ``feedsift.streaming.stateful``.
* R8/R9 — event-time tumbling windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedsift.operators.common import is_missing_path
from feedsift.operators.dedup import anti_join_visited


def read_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def run_available_now(stream: DataFrame, process_batch: Callable[[DataFrame, int], None],
                      checkpoint: str) -> StreamingQuery:
    """Drain everything available, call ``process_batch`` per micro-batch, stop."""
    q = (stream.writeStream.foreachBatch(process_batch).trigger(availableNow=True)
         .option("checkpointLocation", checkpoint).start())
    q.awaitTermination()
    return q


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return spark.createDataFrame([], schema)


def publish_with_visited(out_path: str, visited_path: str, key: str, *,
                         transform: Callable[[DataFrame], DataFrame] | None = None,
                         error: Callable[[DataFrame], DataFrame] | None = None,
                         query_id: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: dedup against ``visited``, publish, then mark visited.

    ``transform`` builds the published rows; ``error`` (optional) adds an
    ``error`` column — failed rows are not marked, so they are retried by the
    next run (at-least-once). ``query_id`` names the run outside a streaming query.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = query_id or spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not run:
            raise ValueError("outside a streaming query, name the run by query_id")
        visited = _read_or_empty(spark, visited_path, f"{key} STRING, query_id STRING, batch_id BIGINT")
        own = (F.col("query_id") == run) & (F.col("batch_id") == batch_id)
        seen = visited.where(~own).select(F.col(key).cast("string").alias("_k"))
        keyed = batch.dropDuplicates([key]).withColumn("_sk", F.col(key).cast("string"))
        fresh = anti_join_visited(keyed, seen, {"_sk": "_k"}).drop("_sk")
        rows = transform(fresh) if transform else fresh
        rows = error(rows) if error else rows.withColumn("error", F.lit(None).cast("string"))
        rows = rows.withColumn("query_id", F.lit(run)).withColumn("batch_id", F.lit(batch_id).cast("bigint")).persist()
        try:
            (rows.where(F.col("error").isNull()).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("query_id", "batch_id").parquet(out_path))
            marks = rows.where(F.col("error").isNull()).select(F.col(key).cast("string").alias(key), "query_id", "batch_id")
            (marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("query_id", "batch_id").parquet(visited_path))
        finally:
            rows.unpersist()

    return process


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a zone-less TIMESTAMP_NTZ column is read as session-time-zone wall time."""
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        return stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream


def dedup_within_ttl(stream: DataFrame, key: str | list[str], ts: str, ttl: str) -> DataFrame:
    """Drop repeats of a key arriving within ``ttl`` of its first occurrence (event time)."""
    keys = [key] if isinstance(key, str) else list(key)
    return event_time(stream, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, window: str, watermark: str, by: list[str] | None = None) -> DataFrame:
    """Event-time tumbling window counts; rows later than the watermark are dropped."""
    g = [F.window(ts, window)] + [F.col(b) for b in (by or [])]
    return event_time(stream, ts).withWatermark(ts, watermark).groupBy(*g).agg(F.count(F.lit(1)).alias("n"))
