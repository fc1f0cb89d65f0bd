"""Skew: one key holds a third of the rows.  Keyed operators must combine it map-side and stay exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.operators import dedup as D
from feedsift.operators import state as S
from feedsift.operators import stats as ST
from feedsift.sinks import documents as DOC
from tests.conftest import MEDIUM


def _skewed(spark):
    ev = spark.read.parquet(f"{MEDIUM}/events.parquet")
    # a third of all rows share one page id
    return ev.select(F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("user_id")).alias("page_id"),
                     F.col("event_id").alias("arrival"), F.col("ts").alias("last_edited"), "event_type", "value")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_per_key_hot_key_partial_and_exact(spark):
    df = _skewed(spark)
    out = D.latest_per_key(df, "page_id", "last_edited", "arrival")
    assert "partial_max_by" in _plan(out)
    want = {r.page_id: r.arrival for r in df.groupBy("page_id").agg(
        F.max_by("arrival", F.struct("last_edited", -F.col("arrival"))).alias("arrival")).collect()}
    assert {r.page_id: r.arrival for r in out.collect()} == want


def test_upsert_and_funnel_hot_key_partial(spark):
    df = _skewed(spark)
    state = df.where(F.col("arrival") % 2 == 0).select("page_id", "last_edited")
    up = S.upsert(state, df.select("page_id", "last_edited", "arrival"), "page_id", overwrite=True, seq="arrival")
    assert "partial_max_by" in _plan(up)
    f = ST.funnel_counts(df.withColumn("list_name", F.col("page_id") % 3), ["list_name"],
                         {"total_input": F.lit(True), "post_deduping": F.col("value") > 10})
    assert "partial_count" in _plan(f)
    tot = sum(r.n for r in f.where(F.col("stage") == "total_input").collect())
    assert tot == df.count()


def test_preferred_transcript_hot_group_partial(spark):
    df = _skewed(spark).select("page_id", "arrival", F.col("event_type").alias("lang"))
    out = DOC.preferred_transcript(df, "page_id", "arrival", "lang", ["view", "click"], url=F.lit(""))
    assert "partial_min_by" in _plan(out)
    assert out.where(F.col("page_id") == 7).count() == 1
