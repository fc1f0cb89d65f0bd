"""State with expiry: streams replayed over files equal the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedsift.operators.dedup import latest_per_key
from feedsift.streaming import micro, stateful
from tests.conftest import SMALL


def _replayed(spark, tmp_path, changes, mode):
    name = "t" + uuid.uuid4().hex
    q = (changes.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.table(name)


def _files(spark, tmp_path, batches, schema):
    src = tmp_path / "src"
    for i, rows in enumerate(batches):
        df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(str(src / f"b{i:03d}"))
    return micro.read_files(spark, f"{src}/*", spark.read.parquet(str(src / "b000")).schema, max_files_per_trigger=1)


def test_rating_changes(spark, tmp_path):
    schema = "page_id string, user_rating int, last_edited timestamp_ntz"
    batches = [spark.sql(f"SELECT * FROM VALUES {v} AS t(page_id, user_rating, last_edited)").select(
        "page_id", F.col("user_rating").cast("int").alias("user_rating"), F.col("last_edited").cast("timestamp_ntz").alias("last_edited")) for v in (
        "('a', 4, '2024-01-01 00:00:00'), ('a', 3, '2024-01-01 01:00:00'), ('b', 5, '2024-01-01 00:30:00'), (null, 1, '2024-01-01 00:00:00')",
        "('a', 4, '2024-01-02 00:00:00'), ('b', 5, '2024-01-02 00:30:00'), ('c', null, '2024-01-02 00:00:00'), ('c', 2, null)",
        "('b', 2, '2024-01-03 00:00:00'), ('b', 1, '2024-01-03 00:00:00'), (null, 1, '2024-01-03 00:00:00')")]
    got = _replayed(spark, tmp_path, stateful.rating_changes(_files(spark, tmp_path, batches, schema)), "append").collect()
    assert sorted(((r.page_id, r.user_rating, r.previous) for r in got), key=repr) == sorted(
        [("a", 3, None), ("b", 5, None), (None, 1, None), ("a", 4, 3), ("b", 2, 5)], key=repr)


def test_newest_versions_equal_the_batch_form(spark, tmp_path):
    """Events of every user in time order over five micro-batches; one user holds a third of the rows."""
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("long").alias("user_id"), "event_type", "event_id",
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, event_id % 997, 0, event_id / 1000000)").alias("ts"))
    ev = ev.withColumn("part", F.ntile(5).over(Window.orderBy("ts"))).persist()
    batches = [ev.where(F.col("part") == i + 1).drop("part") for i in range(5)]
    stream = _files(spark, tmp_path, batches, None)
    changes = _replayed(spark, tmp_path, stateful.newest_versions(stream, "user_id", "ts", ["event_id", "event_type"], "12 hours"), "update")
    now = ev.agg(F.max("ts")).first()[0]
    want = latest_per_key(ev.drop("part").where(F.col("ts") >= F.lit(now) - F.expr("INTERVAL 12 HOURS")), "user_id", "ts", "event_id")
    got = stateful.current_versions(changes, "user_id")
    rows = lambda d: sorted((r.user_id, r.ts, r.event_id, r.event_type) for r in d.collect())
    assert rows(got) == rows(want) and got.count() > 0
    assert changes.where("expired").count() > 0
    assert changes.where("user_id = 0 AND NOT expired").count() <= 5            # at most one a micro-batch
