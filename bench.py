"""Benchmark the headline queries.

Runs each headline query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` (default 8): a warm-up pass over all queries, then
the median of ``$BENCH_REPEAT`` (default 3) timed runs per query.  A run executes the whole plan into
Spark's ``noop`` sink (no collect on the driver).  Prints one JSON line.

With ``BENCH_EVENT_LOG=1`` the session also writes Spark's event log into a
fresh scratch folder and the JSON gains ``shuffle_bytes`` and ``rows_out`` per
query (shuffle bytes written by the first timed run, parsed from the log;
rows from one count).
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedsift.catalog import QUERIES, load_all  # noqa: E402
from feedsift.session import local_session  # noqa: E402

HEADLINE = [
    "relevance_score",      # KNN join (blocked, exact) + threshold + metadata join + mean rating
    "knn_join_cosine",
    "digest_score",         # every vector against every vector, self excluded
    "chunk_retrieve",       # chunk + embed + KNN over all document chunks
    "latest_per_id",
    "dedup_visited",
    "chunk_overlap",
    "mapreduce_summary",
    "page_text",
    "cached_enrich",
    "funnel_counts",
    "curate_posts",         # the dearest composite jobs and text queries
    "collect_evidence",
    "research_dive",
    "embed_text",
    "journal_record",
]


def run_once(spark, name: str, sf_dir: str, tag: str = "") -> float:
    spark.sparkContext.setJobDescription(f"{name}{tag}")
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.sparkContext.setJobDescription(None)
    return time.perf_counter() - t0


def shuffle_bytes_by_description(log_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job description, from Spark's event log."""
    stage_desc: dict[int, str] = {}
    out: dict[str, int] = {}
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (e.get("Properties") or {}).get("spark.job.description")
                    for sid in e.get("Stage IDs", []):
                        if desc:
                            stage_desc[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    desc = stage_desc.get(e.get("Stage ID"))
                    m = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    if desc:
                        out[desc] = out.get(desc, 0) + int(m.get("Shuffle Bytes Written", 0))
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    event_log = os.environ.get("BENCH_EVENT_LOG") == "1"
    load_all()
    conf = {}
    if event_log:
        log_dir = tempfile.mkdtemp(prefix="feedsift-eventlog-")
        conf = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir, "spark.eventLog.compress": "false"}
    spark = local_session(cpus, app="feedsift-bench", conf=conf)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:                                               # warm-up pass over every query (JIT, workers)
        run_once(spark, name, sf_dir, "#warm")
    for name in names:
        runs = [run_once(spark, name, sf_dir, f"#{i}") for i in range(repeat)]
        times[name] = round(statistics.median(runs), 3)
        if event_log:
            rows[name] = QUERIES[name](spark, sf_dir).count()
        print(f"# {name}: {times[name]} s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    result = {"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
              "cpus": int(cpus), "repeat": repeat}
    spark.stop()
    if event_log:
        by = shuffle_bytes_by_description(log_dir)
        result["shuffle_bytes"] = {n: by.get(f"{n}#0", 0) for n in names}
        result["rows_out"] = rows
    print(json.dumps(result))


if __name__ == "__main__":
    main()
