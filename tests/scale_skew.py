"""Hot-key probe (not a registered query): events replicated N times, one page id holding a third of all rows.

Usage: ``python tests/scale_skew.py [replicas]``; prints rows and wall time of the keyed operators.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from feedsift.operators import dedup as D  # noqa: E402
from feedsift.operators import state as S  # noqa: E402
from feedsift.operators import stats as ST  # noqa: E402
from feedsift.session import local_session  # noqa: E402


def main() -> None:
    replicas = int(sys.argv[1]) if len(sys.argv) > 1 else 100
    spark = local_session(8)
    ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    rows = (ev.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
            .select(F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id") * replicas + F.col("rep"))
                    .alias("page_id"),
                    (F.col("event_id") * replicas + F.col("rep")).alias("arrival"),
                    (F.col("ts") + F.make_dt_interval(secs=F.col("rep").cast("double"))).alias("last_edited"),
                    "event_type", "value"))
    rows = rows.checkpoint()
    n = rows.count()
    jobs = {
        "latest_per_key": lambda: D.latest_per_key(rows, "page_id", "last_edited", "arrival"),
        "upsert_last_wins": lambda: S.upsert(rows.where("arrival % 2 = 0").select("page_id", "last_edited"),
                                             rows.select("page_id", "last_edited", "arrival"), "page_id",
                                             overwrite=True, seq="arrival"),
        "funnel_counts": lambda: ST.funnel_counts(rows.withColumn("list_name", F.col("page_id") % 20), ["list_name"],
                                                  {"total_input": F.lit(True), "valued": F.col("value") > 10}),
    }
    for name, job in jobs.items():
        for _ in range(2):
            t0 = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
        print(f"{name}: rows={n} hot_key_rows={n // 3} seconds={dt:.2f}")


if __name__ == "__main__":
    main()
