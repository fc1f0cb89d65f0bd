"""State tables: upserts, TTL, watermarks.

The reference keeps 13 key templates in a KV store; here they are four plain
tables (``watermarks``, ``visited``, ``cache``, ``page_state``).  An upsert is
one union + hash aggregate over (state, delta), which rewrites the touched
state in a single shuffle with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.operators.common import bounded_broadcast


def _lit_ts(ts) -> Column:
    return F.lit(ts) if not isinstance(ts, Column) else ts


def upsert(state: DataFrame, delta: DataFrame, key: str | list[str], *, overwrite: bool,
           ttl_seconds: int | None = None, now=None, seq: str | None = None) -> DataFrame:
    """Merge ``delta`` into ``state`` (composite keys stay key columns).

    * no TTL, no overwrite -> first write wins (existing keys keep their value);
    * no TTL, overwrite    -> last write wins;
    * TTL                  -> last write wins and ``expires_at = now + ttl``.

    Where ``now`` is given, state rows that have expired by then are gone before
    the merge, so they never win a first write.  Within the delta, the last row
    by ``seq`` wins.  Result has the state's columns plus ``origin`` ('state' or
    'delta').
    """
    keys = [key] if isinstance(key, str) else list(key)
    last = overwrite or ttl_seconds is not None
    d = delta
    if now is not None and "expires_at" in state.columns:
        state = ttl_valid(state, now)
    if ttl_seconds is not None:
        d = d.withColumn("expires_at", _lit_ts(now) + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    # priority: who wins on a key collision; then the delta's own order
    s_prio, d_prio = (0, 1) if last else (1, 0)
    s = state.withColumn("_prio", F.lit(s_prio)).withColumn("_seq", F.lit(0).cast("long")).withColumn("origin", F.lit("state"))
    d = (d.withColumn("_prio", F.lit(d_prio))
         .withColumn("_seq", (F.col(seq) if seq else F.lit(0)).cast("long"))
         .withColumn("origin", F.lit("delta")))
    both = s.unionByName(d, allowMissingColumns=True)
    payload = [c for c in both.columns if c not in keys and c not in ("_prio", "_seq")]
    best = F.max_by(F.struct(*payload), F.struct("_prio", "_seq")).alias("_b")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])


def ttl_valid(df: DataFrame, now, expires: str = "expires_at") -> DataFrame:
    """entries count only until they expire (NULL = never)."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > _lit_ts(now)))


def advance_watermarks(stored: DataFrame, batch: DataFrame, key: str | list[str], ts: str,
                       stored_ts: str = "ts") -> DataFrame:
    """A5/R2: per key, ``greatest(stored, max(batch ts))``; a watermark never moves back."""
    keys = [key] if isinstance(key, str) else list(key)
    new = batch.groupBy(*keys).agg(F.max(ts).alias("_new"))
    old = stored.select(*keys, F.col(stored_ts).alias("_old"))
    j = old.join(new, keys, "full_outer")
    return j.select(*keys, F.greatest(F.col("_old"), F.col("_new")).alias("ts"))


def since_watermark(df: DataFrame, watermarks: DataFrame, key: str | list[str], ts: str, *, strict: bool,
                    default_ts, wm_ts: str = "ts") -> DataFrame:
    """Rows newer than their key's watermark, e.g. of (source, category).

    Of several watermark rows of a key the newest counts.

    ``strict`` uses ``>`` (journal), otherwise ``>=`` (re-reads the boundary row,
    which the visited set removes later).  Keys without a watermark start at
    ``default_ts`` (run time minus the look-back).
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = watermarks.groupBy(*[F.col(k).alias(f"_wk{i}") for i, k in enumerate(keys)]).agg(F.max(wm_ts).alias("_wm"))
    w = bounded_broadcast(w)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(w[f"_wk{i}"])
    j = df.join(w, cond, "left")
    bound = F.coalesce(F.col("_wm"), _lit_ts(default_ts))
    cond = F.col(ts) > bound if strict else F.col(ts) >= bound
    return j.where(cond).select(*[df[c] for c in df.columns])
