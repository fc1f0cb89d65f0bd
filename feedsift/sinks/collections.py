"""Dated collections as partitions of a Parquet table.

The table lies under ``path`` partitioned by (model, as_of, batch). A batch writes its own partition with dynamic overwrite, so
a repeated batch replaces its rows instead of adding them again. Old collections are dropped by their folders: the dates are
read from the partition names, and no row is scanned.
"""

from __future__ import annotations

import datetime as dt
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.operators.common import is_missing_path

KEYS = ["model", "as_of", "batch"]
SCHEMA = "item_id string, embedding array<float>, model string, as_of date, batch string"


def append_batch(rows: DataFrame, path: str, batch: str) -> None:
    """K2: the rows without ``error`` as the batch ``batch`` of their collections; a batch that is written again replaces itself."""
    ok = rows.where(F.col("error").isNull()) if "error" in rows.columns else rows
    ok = ok.select("item_id", F.col("embedding").cast("array<float>").alias("embedding"), "model", F.col("as_of").cast("date").alias("as_of"), F.lit(batch).alias("batch"))
    ok.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """All collections; a table that was never written is empty."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if is_missing_path(e):
            return spark.createDataFrame([], SCHEMA)
        raise


def _folders(spark: SparkSession, path: str) -> list[tuple[str, dt.date, object]]:
    """(model, as_of, folder) of every collection, from the folder names."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{path}/model=*/as_of=*")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    out = []
    for status in found or []:
        folder = status.getPath()
        day = folder.getName().removeprefix("as_of=")
        if day != "__HIVE_DEFAULT_PARTITION__":
            out.append((unquote(folder.getParent().getName().removeprefix("model=")), dt.date.fromisoformat(day), folder))
    return sorted(out, key=lambda x: x[:2])


def list_collections(spark: SparkSession, path: str) -> list[tuple[str, dt.date]]:
    """The (model, as_of) of every collection."""
    return [(model, day) for model, day, _ in _folders(spark, path)]


def drop_collections(spark: SparkSession, path: str, run_date: str, days: int) -> list[tuple[str, dt.date]]:
    """Delete the collections dated on or before ``run_date - days``; returns them. Repeating it finds nothing more."""
    last = dt.date.fromisoformat(run_date) - dt.timedelta(days=days)
    old = [x for x in _folders(spark, path) if x[1] <= last]
    for _, _, folder in old:
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return [(model, day) for model, day, _ in old]
