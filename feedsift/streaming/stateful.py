"""Keyed state with expiry in Structured Streaming (R6, R7), by ``transformWithState``.

Rows of a micro-batch are reduced to the newest one per key and Arrow batch before the shuffle, so a hot key sends few
rows to the task that holds its state; the state of a key is one value. These queries need the RocksDB state store
as ``spark.sql.streaming.stateStore.providerClass`` (the sessions of ``feedsift.session`` name it).

* R6 - ``rating_changes``: a row when a key's newest rating of a micro-batch differs from the stored one.
* R7 - ``newest_versions``: the newest version per key over a sliding look-back: a row whenever a newer version comes, and
  one when the newest version has left the look-back (an event-time timer). ``current_versions`` reads such rows back as
  the table that the batch form (``dedup.latest_per_key`` over a look-back scan) gives.

Rows without a time (for R6: or without a rating) are passed over. Of equal times the greatest remaining columns, as JSON
text, win. Rows older than the look-back before the newest time of earlier micro-batches are late and dropped (R10).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedsift.session import ROCKSDB
from feedsift.streaming.micro import event_time

PROVIDER = "spark.sql.streaming.stateStore.providerClass"

def _newest_per_key(key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each Arrow batch the last row per key by (``_us``, ``_tie``)."""

    def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("_us", "ascending"), ("_tie", "ascending")])
            places = pa.table({"k": t[key], "i": np.arange(len(t))}).group_by("k", use_threads=False).aggregate([("i", "max")])
            yield from t.take(places["i_max"]).to_batches()

    return newest


def _combined(stream: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """``key, ts, columns`` with ``_us`` (the time in microseconds) and ``_tie``, reduced map-side."""
    rows = event_time(stream, ts).where(F.col(ts).isNotNull()).select(
        key, ts, *columns, F.unix_micros(ts).alias("_us"), F.to_json(F.struct(*columns)).alias("_tie"))
    return rows.mapInArrow(_newest_per_key(key), rows.schema)


def _last(rows: Iterator[Row]) -> Row | None:
    """The newest row; none where all rows of the key were late."""
    return max(rows, key=lambda r: (r["_us"], r["_tie"]), default=None)


class RatingChanges(StatefulProcessor):
    """The state of a key is its last rating."""

    def __init__(self, rating: str, ts: str):
        self.rating, self.ts = rating, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("rating", "rating int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = _last(rows)
        if new is None:
            return
        old = self.stored.get()
        previous = None if old is None else old[0]
        if previous != new[self.rating]:
            self.stored.update((new[self.rating],))
            yield Row(page_id=key[0], user_rating=new[self.rating], previous=previous, ts=new[self.ts])

    def close(self) -> None:
        pass


def rating_changes(stream: DataFrame, key: str = "page_id", rating: str = "user_rating", ts: str = "last_edited") -> DataFrame:
    """Per micro-batch and key the newest rated version is compared with the stored rating; a row (``page_id, user_rating,
    previous, ts``) is emitted only when it differs. First sight counts as a change from null."""
    src = stream.select(key, F.col(rating).cast("int").alias(rating), ts).where(F.col(rating).isNotNull())
    out = T.StructType().add("page_id", stream.schema[key].dataType).add("user_rating", "integer").add("previous", "integer").add("ts", "timestamp")
    return _combined(src, key, ts, [rating]).groupBy(key).transformWithState(RatingChanges(rating, ts), out, "append", "none")


class NewestVersion(StatefulProcessor):
    """The state of a key is its newest version; a timer ends it once the watermark has passed the version's time."""

    def __init__(self, key: str, columns: list[str], state: T.StructType):
        self.key, self.columns, self.state = key, columns, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.state)

    def _row(self, key: Any, version: tuple, expired: bool) -> Row:
        return Row(**{self.key: key[0]}, **dict(zip(self.columns, version)), _us=version[-2], expired=expired)

    @staticmethod
    def _ends(version: tuple) -> int:
        return version[-2] // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = _last(rows)
        if last is None:
            return
        new = tuple(last[c] for c in [*self.columns, "_us", "_tie"])
        old = self.newest.get()
        if old is not None:
            if tuple(old)[-2:] >= new[-2:]:
                return
            self.handle.deleteTimer(self._ends(tuple(old)))
        self.newest.update(new)
        self.handle.registerTimer(self._ends(new))
        yield self._row(key, new, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        old = self.newest.get()
        if old is not None and self._ends(tuple(old)) <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
            yield self._row(key, tuple(old), True)

    def close(self) -> None:
        pass


def newest_versions(stream: DataFrame, key: str, ts: str, columns: list[str], look_back: str = "30 days") -> DataFrame:
    """Rows ``key, ts, columns, _us, expired``: a newer version of a key, or (``expired``) the end of its newest one.

    "Now" is the newest time of the stream: the watermark trails it by ``look_back``.
    """
    rows = _combined(stream, key, ts, columns).withWatermark(ts, look_back)
    kept = [ts, *columns]
    state = T.StructType([rows.schema[c] for c in [*kept, "_us", "_tie"]])
    out = T.StructType([rows.schema[c] for c in [key, *kept, "_us"]]).add("expired", "boolean")
    return rows.groupBy(key).transformWithState(NewestVersion(key, kept, state), out, "update", "EventTime")


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Drain what is available into ``path``; a replayed micro-batch overwrites its own folder. The stateful query starts
    with the RocksDB state store, whatever the session names for others."""
    spark = changes.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        q = (changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
             .foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/batch={n}")).start())
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current_versions(changes: DataFrame, key: str) -> DataFrame:
    """The newest version of each key that has not expired, from the rows of ``newest_versions``."""
    cols = [c for c in changes.columns if c not in (key, "_us", "expired")]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*cols, "expired"), F.struct("_us", "expired")).alias("v"))
    return last.where(~F.col("v.expired")).select(key, *(F.col("v")[c].alias(c) for c in cols))
