"""State tables on shared storage (X4; K10, K11, A5, R2).

The four state tables (``watermarks``, ``visited``, ``cache``, ``page_state``)
live as Parquet under one root on the cluster's shared file system.  A merge
reads the newest committed version, applies the upsert rule from
``feedsift.operators.state`` and writes the next numbered version.  There is no
pointer to lose: a merge that fails leaves a folder without ``_SUCCESS``, which
is never read, and the previous version stays current; a folder that can't be
listed or read is an error, never an empty table.  A few versions are kept for
readers that still use them.  One writer at a time (the jobs run one at a time).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedsift.operators import state as S

SCHEMAS = {
    "watermarks": "kind STRING, source STRING, category STRING, ts TIMESTAMP",
    "visited": "namespace STRING, source STRING, scope STRING, item_id STRING, expires_at TIMESTAMP",
    "cache": "kind STRING, model STRING, source STRING, scope STRING, item_id STRING, value STRING, expires_at TIMESTAMP",
    "page_state": "page_id STRING, last_edited_time TIMESTAMP, user_rating INT, todo STRING, action_title STRING, "
                  "expires_at TIMESTAMP",
}
KEYS = {
    "watermarks": ["kind", "source", "category"],
    "visited": ["namespace", "source", "scope", "item_id"],
    "cache": ["kind", "model", "source", "scope", "item_id"],
    "page_state": ["page_id"],
}


class StateStore:
    """Numbered versions of each table; a version counts once Spark's writer has committed it (``_SUCCESS``)."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _versions(self, table: str) -> list[str]:
        """Committed versions, oldest first (a listing of one folder, no job)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("v-")]
        child = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in names if fs.exists(child(path, f"{n}/_SUCCESS")))

    def read(self, table: str) -> DataFrame:
        done = self._versions(table)
        if not done:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.parquet(f"{self.root}/{table}/{done[-1]}")

    def _publish(self, table: str, df: DataFrame) -> None:
        done = self._versions(table)
        number = int(done[-1].split("-")[1]) + 1 if done else 1
        df.write.mode("errorifexists").parquet(f"{self.root}/{table}/v-{number:012d}-{uuid.uuid4().hex}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in done[:-self.keep]:
            p = path(f"{self.root}/{table}/{old}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def merge(self, table: str, delta: DataFrame, *, overwrite: bool, ttl_seconds: int | None = None,
              now=None, seq: str | None = None) -> DataFrame:
        """Upsert of ``delta`` into ``table`` (first/last wins, TTL) and publish the new version."""
        cols = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        cur = self.read(table)
        merged = S.upsert(cur, delta, KEYS[table], overwrite=overwrite, ttl_seconds=ttl_seconds, now=now, seq=seq)
        out = merged.select(*cols)
        self._publish(table, out)
        return self.read(table)
