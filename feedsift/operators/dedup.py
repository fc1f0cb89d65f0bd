"""De-duplication and versioning.

All operators are joins or aggregates with map-side partial aggregation,
so a hot key (one id holding a large share of the rows) is reduced before the
shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.operators.common import BROADCAST_MAX_BYTES, estimated_bytes
from feedsift.operators.segments import keep_within_ttl


def _keys_cond(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    cond = None
    for lk, rk in pairs.items():
        c = left[lk] == right[rk]
        cond = c if cond is None else cond & c
    return cond


def anti_join_visited(items: DataFrame, visited: DataFrame, on: dict[str, str]) -> DataFrame:
    """Items whose key is not in the visited set (bag semantics, a left anti join).

    ``on`` maps item columns to visited columns.  The visited history grows
    without bound while a batch is small, so when the batch's keys are estimated
    small they are broadcast to semi-filter the history map-side first; only the
    matching history rows meet the batch.  Otherwise a plain shuffle anti join
    is used.
    """
    v = _history_for(items, visited, on)
    return items.join(v, _keys_cond(items, v, on), "left_anti")


def _history_for(items: DataFrame, visited: DataFrame, on: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """The history rows that can match this batch, semi-filtered by the batch's keys when those are estimated small."""
    v = visited.select(*[F.col(c) for c in on.values()], *[F.col(c) for c in (keep or []) if c not in on.values()])
    # duplicates on the build side of a semi join are harmless, so no distinct (and no shuffle) is needed
    keys = items.select(*[F.col(k).alias(v_) for k, v_ in on.items()])
    if estimated_bytes(keys) <= BROADCAST_MAX_BYTES:
        v = v.join(F.broadcast(keys), list(on.values()), "left_semi")
    return v


def visited_flags(items: DataFrame, visited: DataFrame, on: dict[str, str], flag: str = "is_visited") -> DataFrame:
    """Items with a boolean ``flag``: the key is in the visited set; a marker stored twice counts once."""
    v = _history_for(items, visited, on).distinct().withColumn("_hit", F.lit(True))
    out = items.join(v, _keys_cond(items, v, on), "left")
    return out.select(*[items[c] for c in items.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias(flag))


def dedup_tallies(items: DataFrame, visited: DataFrame, on: dict[str, str], by: list[str]) -> DataFrame:
    """A10: per group ``total``, ``duplicate``, ``new`` counts in one pass."""
    f = visited_flags(items, visited, on)
    return f.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                              F.count_if(F.col("is_visited")).alias("duplicate"),
                              F.count_if(~F.col("is_visited")).alias("new"))


def changed_since_processed(pages: DataFrame, state: DataFrame, key: str, version: str,
                            state_version: str | None = None) -> DataFrame:
    """Keep pages never processed or whose stored version differs (inequality, trap Q11)."""
    sv = state_version or version
    s = state.select(F.col(key).alias("_k"), F.col(sv).alias("_sv"), F.lit(True).alias("_seen"))
    s = _history_for(pages, s, {key: "_k"}, keep=["_sv", "_seen"]).groupBy("_k").agg(F.max("_sv").alias("_sv"), F.max("_seen").alias("_seen"))
    j = pages.join(s, pages[key] == s["_k"], "left")
    keep = F.col("_seen").isNull() | ~(F.col(version).eqNullSafe(F.col("_sv")))
    return j.where(keep).select(*[pages[c] for c in pages.columns])


def rating_change_split(pages: DataFrame, visited: DataFrame, page_state: DataFrame, *,
                        key: str = "page_id", visited_key: str = "item_id", rating: str = "user_rating") -> DataFrame:
    """Flags ``is_new`` (never indexed) and ``is_updated`` (new, no metadata, or rating changed)."""
    v = visited.select(F.col(visited_key).alias("_vk"), F.lit(True).alias("_visited"))
    m = page_state.select(F.col(key).alias("_mk"), F.col(rating).alias("_stored"), F.lit(True).alias("_meta"))
    v = _history_for(pages, v, {key: "_vk"}, keep=["_visited"]).distinct()
    m = _history_for(pages, m, {key: "_mk"}, keep=["_stored", "_meta"])
    m = m.groupBy("_mk").agg(F.max("_stored").alias("_stored"), F.max("_meta").alias("_meta"))   # one row per page, whatever is stored twice
    j = pages.join(v, pages[key] == v["_vk"], "left").join(m, pages[key] == m["_mk"], "left")
    visited_ = F.coalesce(F.col("_visited"), F.lit(False))
    has_meta = F.coalesce(F.col("_meta"), F.lit(False))
    changed = ~F.col(rating).eqNullSafe(F.col("_stored"))
    return j.select(*[pages[c] for c in pages.columns],
                    (~visited_).alias("is_new"),
                    ((~visited_) | (visited_ & ~has_meta) | (visited_ & has_meta & changed)).alias("is_updated"))


def latest_per_key(df: DataFrame, key: str | list[str], version: str, arrival: str) -> DataFrame:
    """Newest ``version`` per key; a tie keeps the first arrival (strict ``>``, trap Q10).

    One hash aggregate (``max_by`` over a struct) with partial aggregation on
    the map side: a hot key is combined before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(version), -F.col(arrival))
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def last_wins(df: DataFrame, key: str | list[str], arrival: str) -> DataFrame:
    """The last arrival per key wins (dict assignment)."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in payload]), F.col(arrival)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload])


def keyed_union(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """``dict.update``: union by key, the right side overrides the left."""
    l_ = left.withColumn("_side", F.lit(0))
    r_ = right.withColumn("_side", F.lit(1))
    return last_wins(l_.unionByName(r_, allowMissingColumns=True), key, "_side").drop("_side")


def bag_union(*dfs: DataFrame) -> DataFrame:
    """``list.extend``: union by name, missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def dedup_within_ttl(df: DataFrame, key: str | list[str], ts: str, ttl_seconds: int,
                     tiebreak: list[str] | None = None) -> DataFrame:
    """R5 (batch): keep a row unless a *kept* row of the same key lies within ``ttl_seconds`` before it.

    A visited marker with a TTL is set when a row is kept, so the kept set is a
    chain: each kept row opens a TTL window, later rows inside it are dropped,
    the first row after it is kept again.  The chain is followed over sorted
    segments of bounded size (``operators/segments.py``), so that a key holding
    a third of the rows is worked on by as many tasks as its rows need.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return keep_within_ttl(df, keys, ts, ttl_seconds, tiebreak or [])
