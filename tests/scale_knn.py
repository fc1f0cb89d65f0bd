"""Scale probe for the blocked KNN join (not a registered query): the embeddings table replicated with seeded noise.

Usage: ``python tests/scale_knn.py [replicas]``.  Rated side = every embedding x ``replicas`` with N(0, 0.01) noise
(seeded per replica), queries = the original embeddings; prints rows, block grid and wall time.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from feedsift.operators import knn  # noqa: E402
from feedsift.session import local_session  # noqa: E402


def main() -> None:
    replicas = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    spark = local_session(8)
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rated = (e.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))   # fixed-factor replication
             .select((F.col("vec_id") * replicas + F.col("rep")).alias("item_id"),
                     F.transform("embedding", lambda x, i: x + F.randn(7) * 0.01).alias("embedding")))
    rated = rated.checkpoint()                       # materialise the probe input once
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    n_r, n_q = rated.count(), q.count()
    for _ in range(2):
        t0 = time.perf_counter()
        n = knn.knn_join(q, rated, 2, "IP").count()
        dt = time.perf_counter() - t0
    print(f"queries={n_q} rated={n_r} neighbours={n} seconds={dt:.2f}")


if __name__ == "__main__":
    main()
