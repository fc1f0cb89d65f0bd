"""Plan properties the design relies on: pushdown, pruning, no shuffle where none is needed."""

from __future__ import annotations

import re

from feedsift.catalog import QUERIES, load_all
from tests.conftest import MEDIUM

load_all()


def _plan(spark, name: str) -> str:
    df = QUERIES[name](spark, MEDIUM)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(plan: str) -> int:
    return len(re.findall(r"Exchange (hashpartitioning|RoundRobinPartitioning|SinglePartition|rangepartitioning)", plan))


def test_source_filter_reaches_parquet(spark):
    plan = _plan(spark, "scan_rated_since")
    assert "EqualTo(event_type,click)" in plan


def test_time_bound_reaches_parquet(spark):
    import datetime as dt

    from feedsift.sources.scans import created_since

    events = spark.read.parquet(f"{MEDIUM}/events.parquet")
    df = created_since(events, dt.datetime(2024, 1, 10), strict=False, created="ts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(ts,2024-01-10", plan)


def test_dedup_reads_keys_only_and_does_not_shuffle(spark):
    plan = _plan(spark, "dedup_visited")
    for schema in re.findall(r"ReadSchema: (struct<[^>]*>)", plan):
        assert "text" not in schema
    assert _exchanges(plan) == 0


def test_fixed_chunking_is_a_pure_map(spark):
    assert _exchanges(_plan(spark, "chunk_overlap")) == 0


def test_latest_per_key_combines_before_its_single_shuffle(spark):
    plan = _plan(spark, "latest_per_id")
    assert "partial_max_by" in plan and _exchanges(plan) == 1


def test_knn_scoring_of_a_small_batch_leaves_the_rated_side_in_place(spark):
    plan = _plan(spark, "relevance_score")
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert _exchanges(plan) == 2          # each task's k best per query, and the queries that keep_empty joins back


def test_knn_scoring_of_a_large_batch_shuffles_for_cells_and_top_k(spark):
    plan = _plan(spark, "knn_cells_l2")
    assert "FlatMapCoGroupsInPandas" in plan and "Window" in plan
    assert _exchanges(plan) == 3          # both sides of the further visits, and the candidates by query
