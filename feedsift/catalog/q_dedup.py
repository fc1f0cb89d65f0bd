"""De-duplication, versioning, state and scan queries (J1-J4, J12-J13, W1, W2, U1, U2, A5, A10, A12,
K10, K11, F13, R1, R3, R7, S2-S8, S14-S20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import RUN_DATE, RUN_TS, SINCE_TS, duck_ts_text, ts, ts_text
from feedsift.operators import dedup as D
from feedsift.operators import state as S
from feedsift.session import ensure_checkpoint_dir
from feedsift.sources import scans as SC
from feedsift.streaming import micro, stateful

_TS = duck_ts_text


# ---------------------------------------------------------------- J1-J4, A10
@register("dedup_visited", uses=("items", "visited"), sql="""
SELECT i.id, i.list_name FROM items i
WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.item_id = i.id AND v.list_name = i.list_name)""")
def dedup_visited(spark, sf):
    """Items not yet visited, keyed by (list, id)."""
    items = binding(spark, sf, "items")
    out = D.anti_join_visited(items, binding(spark, sf, "visited"), {"id": "item_id", "list_name": "list_name"})
    return out.select("id", "list_name")


@register("dedup_tallies", uses=("items", "visited"), sql="""
SELECT i.list_name, CAST(count(*) AS BIGINT) AS total, CAST(count(v.item_id) AS BIGINT) AS duplicate,
       CAST(count(*) - count(v.item_id) AS BIGINT) AS new
FROM items i LEFT JOIN visited v ON v.item_id = i.id AND v.list_name = i.list_name GROUP BY i.list_name""")
def dedup_tallies(spark, sf):
    """A10: total / duplicate / new per list in one pass."""
    items = binding(spark, sf, "items")
    return D.dedup_tallies(items, binding(spark, sf, "visited"), {"id": "item_id", "list_name": "list_name"},
                           ["list_name"])


@register("dedup_changed", uses=("versions", "todo_state"), sql="""
SELECT v.arrival, v.page_id FROM versions v LEFT JOIN todo_state s ON v.page_id = s.page_id
WHERE s.page_id IS NULL OR v.last_edited IS DISTINCT FROM s.last_edited""")
def dedup_changed(spark, sf):
    """Pages never processed, or whose stored edit time differs (inequality)."""
    v = binding(spark, sf, "versions")
    out = D.changed_since_processed(v, binding(spark, sf, "todo_state"), "page_id", "last_edited")
    return out.select("arrival", "page_id")


@register("dedup_once", uses=("versions", "todo_state"), sql="""
SELECT arrival, page_id FROM versions WHERE page_id NOT IN (SELECT page_id FROM todo_state)""")
def dedup_once(spark, sf):
    """Pages never acted on."""
    v = binding(spark, sf, "versions")
    out = D.anti_join_visited(v, binding(spark, sf, "todo_state"), {"page_id": "page_id"})
    return out.select("arrival", "page_id")


@register("rating_change_split", uses=("ratings", "visited", "page_state"), sql="""
SELECT r.page_id, v.item_id IS NULL AS is_new,
       v.item_id IS NULL OR m.page_id IS NULL OR r.user_rating IS DISTINCT FROM m.user_rating AS is_updated
FROM ratings r LEFT JOIN (SELECT DISTINCT item_id FROM visited) v ON r.page_id = v.item_id
LEFT JOIN page_state m ON r.page_id = m.page_id""")
def rating_change_split(spark, sf):
    """J4/R6 (batch): new pages and pages whose rating changed since indexing."""
    r = binding(spark, sf, "ratings")
    vis = binding(spark, sf, "visited").select("item_id").distinct()
    out = D.rating_change_split(r, vis, binding(spark, sf, "page_state"))
    return out.select("page_id", "is_new", "is_updated")


# ---------------------------------------------------------------- W1, W2, U1, U2
@register("latest_per_id", uses=("versions",), sql=f"""
SELECT page_id, arrival, {_TS("last_edited")} AS last_edited, user_rating, source FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY last_edited DESC, arrival ASC) AS rn FROM versions)
WHERE rn = 1""")
def latest_per_id(spark, sf):
    """Newest version per page; a tie keeps the first arrival."""
    v = binding(spark, sf, "versions")
    out = D.latest_per_key(v, "page_id", "last_edited", "arrival")
    return out.select("page_id", "arrival", ts_text("last_edited").alias("last_edited"), "user_rating", "source")


@register("latest_per_id_30d", uses=("versions",), sql=f"""
SELECT page_id, arrival, {_TS("last_edited")} AS last_edited FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY last_edited DESC, arrival ASC) AS rn FROM versions
  WHERE day > DATE '{RUN_DATE}' - 30 AND day <= DATE '{RUN_DATE}')
WHERE rn = 1""")
def latest_per_id_30d(spark, sf):
    """Latest version per page over the 30-day look-back ending on the run date."""
    v = SC.lookback(binding(spark, sf, "versions"), "day", RUN_DATE, 30)
    out = D.latest_per_key(v.select("page_id", "arrival", "last_edited"), "page_id", "last_edited", "arrival")
    return out.select("page_id", "arrival", ts_text("last_edited").alias("last_edited"))


@register("last_wins", uses=("versions",), sql="""
SELECT page_id, max(arrival) AS arrival FROM versions GROUP BY page_id""")
def last_wins(spark, sf):
    """Last arrival per page wins."""
    v = binding(spark, sf, "versions").select("page_id", "arrival")
    return D.last_wins(v.withColumn("a", F.col("arrival")), "page_id", "a").select("page_id", "arrival")


@register("keyed_union", uses=("versions",), sql="""
, l AS (SELECT page_id, max(arrival) AS arrival FROM versions WHERE source = 'view' GROUP BY page_id)
, r AS (SELECT page_id, max(arrival) AS arrival FROM versions WHERE source = 'click' GROUP BY page_id)
SELECT coalesce(r.page_id, l.page_id) AS page_id, coalesce(r.arrival, l.arrival) AS arrival,
       CASE WHEN r.page_id IS NOT NULL THEN 'click' ELSE 'view' END AS side
FROM l FULL OUTER JOIN r ON l.page_id = r.page_id""")
def keyed_union(spark, sf):
    """Per page the last view and the last click batch; the right (click) side overrides."""
    v = binding(spark, sf, "versions")
    left = D.last_wins(v.where(F.col("source") == "view").select("page_id", "arrival", F.lit("view").alias("side")),
                       "page_id", "arrival")
    right = D.last_wins(v.where(F.col("source") == "click").select("page_id", "arrival", F.lit("click").alias("side")),
                        "page_id", "arrival")
    return D.keyed_union(left, right, "page_id").select("page_id", "arrival", "side")


@register("bag_union", uses=("versions",), sql="""
SELECT arrival, page_id, source FROM versions WHERE source = 'view'
UNION ALL SELECT arrival, page_id, source FROM versions WHERE source = 'click'""")
def bag_union(spark, sf):
    """Plain union of two batches."""
    v = binding(spark, sf, "versions").select("arrival", "page_id", "source")
    return D.bag_union(v.where(F.col("source") == "view"), v.where(F.col("source") == "click"))


# ---------------------------------------------------------------- K10, K11, F13, A5, R3
_UPSERT = """
, d AS (SELECT page_id, last_edited FROM (
          SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY arrival DESC) AS rn FROM versions
          WHERE source = 'purchase') WHERE rn = 1)
SELECT coalesce(s.page_id, d.page_id) AS page_id,
       {ts} AS last_edited,
       CASE WHEN {cond} THEN 'state' ELSE 'delta' END AS origin
FROM todo_state s FULL OUTER JOIN d ON s.page_id = d.page_id"""


@register("state_upsert_first", uses=("todo_state", "versions"), sql=_UPSERT.format(
    ts=_TS("coalesce(s.last_edited, d.last_edited)"), cond="s.page_id IS NOT NULL"))
def state_upsert_first(spark, sf):
    """No TTL, no overwrite -> the first write wins."""
    state = binding(spark, sf, "todo_state")
    delta = binding(spark, sf, "versions").where(F.col("source") == "purchase").select("page_id", "last_edited", "arrival")
    out = S.upsert(state, delta, "page_id", overwrite=False, seq="arrival")
    return out.select("page_id", ts_text("last_edited").alias("last_edited"), "origin")


@register("state_upsert_last", uses=("todo_state", "versions"), sql=_UPSERT.format(
    ts=_TS("coalesce(d.last_edited, s.last_edited)"), cond="d.page_id IS NULL"))
def state_upsert_last(spark, sf):
    """Overwrite -> the last write wins (within the delta: last arrival)."""
    state = binding(spark, sf, "todo_state")
    delta = binding(spark, sf, "versions").where(F.col("source") == "purchase").select("page_id", "last_edited", "arrival")
    out = S.upsert(state, delta, "page_id", overwrite=True, seq="arrival")
    return out.select("page_id", ts_text("last_edited").alias("last_edited"), "origin")


@register("page_state_upsert", uses=("page_state", "ratings"), sql=f"""
SELECT coalesce(r.page_id, s.page_id) AS page_id, coalesce(r.user_rating, s.user_rating) AS user_rating,
       CASE WHEN r.page_id IS NOT NULL THEN {_TS(f"TIMESTAMP '{RUN_TS}' + INTERVAL 30 DAY")} END AS expires_at,
       CASE WHEN r.page_id IS NOT NULL THEN 'delta' ELSE 'state' END AS origin
FROM page_state s FULL OUTER JOIN ratings r ON s.page_id = r.page_id""")
def page_state_upsert(spark, sf):
    """Rated metadata upsert, last wins, expiry reset to now + 30 days."""
    state = binding(spark, sf, "page_state")
    delta = binding(spark, sf, "ratings")
    out = S.upsert(state, delta, "page_id", overwrite=True, ttl_seconds=30 * 24 * 3600, now=ts(RUN_TS))
    return out.select("page_id", "user_rating", ts_text("expires_at").alias("expires_at"), "origin")


@register("ttl_valid", uses=("cache",), sql=f"""
SELECT item_id, value FROM cache
WHERE (CASE WHEN expired THEN TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY ELSE TIMESTAMP '{RUN_TS}' + INTERVAL 1 DAY END)
      > TIMESTAMP '{RUN_TS}'""")
def ttl_valid(spark, sf):
    """cached entries count only until their expiry."""
    c = binding(spark, sf, "cache")
    c = c.withColumn("expires_at", F.when(F.col("expired"), ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
                     .otherwise(ts(RUN_TS) + F.expr("INTERVAL 1 DAY")))
    return S.ttl_valid(c, ts(RUN_TS)).select("item_id", "value")


@register("advance_watermark", uses=("watermarks", "versions"), sql=f"""
, b AS (SELECT source, max(last_edited) AS mx FROM versions GROUP BY source)
SELECT coalesce(w.source, b.source) AS source, {_TS("greatest(w.ts, b.mx)")} AS ts
FROM watermarks w FULL OUTER JOIN b ON w.source = b.source""")
def advance_watermark(spark, sf):
    """A5: watermark = greatest(stored, newest edit in the batch) per source; never backwards."""
    out = S.advance_watermarks(binding(spark, sf, "watermarks"), binding(spark, sf, "versions"), "source", "last_edited")
    return out.select("source", ts_text("ts").alias("ts"))


@register("resume_boundary", uses=("versions", "watermarks"), sql=f"""
, j AS (SELECT v.source, v.last_edited, coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY) AS b
        FROM versions v LEFT JOIN watermarks w ON v.source = w.source)
SELECT source, CAST(count_if(last_edited >= b) AS BIGINT) AS n_inclusive,
       CAST(count_if(last_edited > b) AS BIGINT) AS n_strict FROM j GROUP BY source""")
def resume_boundary(spark, sf):
    """Inclusive (>=) resume re-reads the boundary row, strict (>) does not."""
    v = binding(spark, sf, "versions")
    wm = binding(spark, sf, "watermarks")
    default = ts(RUN_TS) - F.expr("INTERVAL 1 DAY")
    inc = S.since_watermark(v, wm, "source", "last_edited", strict=False, default_ts=default)
    strict = S.since_watermark(v, wm, "source", "last_edited", strict=True, default_ts=default)
    a = inc.groupBy("source").agg(F.count(F.lit(1)).alias("n_inclusive"))
    b = strict.groupBy("source").agg(F.count(F.lit(1)).alias("n_strict"))
    return a.join(b, "source", "full_outer").select(
        "source", F.coalesce("n_inclusive", F.lit(0)).cast("bigint").alias("n_inclusive"),
        F.coalesce("n_strict", F.lit(0)).cast("bigint").alias("n_strict"))


# ---------------------------------------------------------------- S2-S8
@register("scan_lookback_30d", uses=("versions",), sql=f"""
SELECT arrival, day FROM versions WHERE day > DATE '{RUN_DATE}' - 30 AND day <= DATE '{RUN_DATE}'""")
def scan_lookback_30d(spark, sf):
    """The 30 daily partitions ending on the run date."""
    return SC.lookback(binding(spark, sf, "versions"), "day", RUN_DATE, 30).select("arrival", "day")


@register("scan_rated_since", uses=("rated_pages",), sql=f"""
SELECT id, arrival, CAST(user_rating AS INTEGER) AS user_rating FROM rated_pages
WHERE source = 'click' AND last_edited_time >= TIMESTAMP '{SINCE_TS}' AND user_rating IS NOT NULL AND user_rating <> ''""")
def scan_rated_since(spark, sf):
    """S3: rated pages of one source edited since t (rating cast to INT)."""
    r = SC.rated_since(binding(spark, sf, "rated_pages"), "click", ts(SINCE_TS))
    return r.select("id", "arrival", "user_rating")


@register("scan_inbox_since", uses=("notes",), sql=f"""
SELECT id FROM notes WHERE created_time >= TIMESTAMP '{SINCE_TS}'
  AND last_edited_time > TIMESTAMP '{SINCE_TS}' + INTERVAL 12 HOUR""")
def scan_inbox_since(spark, sf):
    """Inbox pages created since t (inclusive) and edited after t2."""
    n = SC.created_since(binding(spark, sf, "notes"), ts(SINCE_TS), strict=False,
                         edited_after=ts(SINCE_TS) + F.expr("INTERVAL 12 HOURS"))
    return n.select("id")


@register("scan_journal_after", uses=("notes",), sql=f"""
SELECT id FROM notes WHERE created_time > TIMESTAMP '{SINCE_TS}'""")
def scan_journal_after(spark, sf):
    """Journal pages created strictly after t."""
    return SC.created_since(binding(spark, sf, "notes"), ts(SINCE_TS), strict=True).select("id")


@register("scan_enabled_subs", uses=("subscriptions",), sql="""
SELECT member, array_to_string(list_names, '|') AS list_names FROM subscriptions WHERE enabled""")
def scan_enabled_subs(spark, sf):
    """Enabled subscriptions."""
    s = SC.enabled(binding(spark, sf, "subscriptions"))
    return s.select("member", F.array_join("list_names", "|").alias("list_names"))


@register("latest_two_partitions", uses=("partitions",), sql="""
, top2 AS (SELECT partition_id FROM partitions ORDER BY created_time DESC, partition_id DESC LIMIT 2)
SELECT CAST(year(o_orderdate) AS INTEGER) AS partition_id, CAST(count(*) AS BIGINT) AS n_rows
FROM orders WHERE CAST(year(o_orderdate) AS INTEGER) IN (SELECT partition_id FROM top2)
GROUP BY year(o_orderdate)""")
def latest_two_partitions(spark, sf):
    """Newest two partitions from the registry, then a semi join of the data to them."""
    chosen = SC.latest_partitions(binding(spark, sf, "partitions"), 2)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.year("o_orderdate").cast("int").alias("partition_id"))
    data = SC.restrict_to_partitions(orders, chosen, "partition_id")
    return data.groupBy("partition_id").agg(F.count(F.lit(1)).alias("n_rows"))


@register("feed_head_n", uses=("feed_entries",), sql="""
SELECT feed, pos, title FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) AS rn FROM feed_entries)
WHERE rn <= 3""")
def feed_head_n(spark, sf):
    """First 3 entries per feed in feed order."""
    e = binding(spark, sf, "feed_entries")
    return SC.head_per_group(e, "feed", [F.col("pos")], 3).select("feed", "pos", "title")


@register("load_all_sources", uses=("items", "posts"), sql="""
SELECT 'documents' AS source, CAST(id AS VARCHAR) AS id, title, lang FROM items
UNION ALL SELECT 'posts' AS source, id, title, NULL AS lang FROM posts""")
def load_all_sources(spark, sf):
    """One batch per configured source, unioned by name with a literal source column."""
    a = binding(spark, sf, "items").select(F.lit("documents").alias("source"), F.col("id").cast("string").alias("id"),
                                           "title", "lang")
    b = binding(spark, sf, "posts").select(F.lit("posts").alias("source"), "id", "title")
    return D.bag_union(a, b).select("source", "id", "title", "lang")


# ---------------------------------------------------------------- S15-S20, A12
_PULL = """
SELECT p.id, p.arrival FROM rated_pages p LEFT JOIN watermarks w ON p.source = w.source
WHERE p.last_edited_time {op} coalesce(w.ts, TIMESTAMP '%s' - INTERVAL 1 DAY)""" % RUN_TS


@register("pull_since_watermark", uses=("rated_pages", "watermarks"), sql=_PULL.format(op=">="))
def pull_since_watermark(spark, sf):
    """Pages edited at/after their source's watermark (default: run time - 1 day); rating not required."""
    p = binding(spark, sf, "rated_pages")
    out = S.since_watermark(p, binding(spark, sf, "watermarks"), "source", "last_edited_time", strict=False,
                            default_ts=ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
    return out.select("id", "arrival")


@register("pull_journal_since", uses=("rated_pages", "watermarks"), sql=_PULL.format(op=">"))
def pull_journal_since(spark, sf):
    """As S15 with a strict bound."""
    p = binding(spark, sf, "rated_pages")
    out = S.since_watermark(p, binding(spark, sf, "watermarks"), "source", "last_edited_time", strict=True,
                            default_ts=ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
    return out.select("id", "arrival")


@register("pull_inbox", uses=("notes", "note_watermarks"), sql=f"""
SELECT n.id FROM notes n LEFT JOIN note_watermarks w ON n.source = w.source
WHERE n.created_time >= coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY)""")
def pull_inbox(spark, sf):
    """Inbox pages created at/after their source's watermark (default look-back 1 day)."""
    n = binding(spark, sf, "notes")
    out = S.since_watermark(n, binding(spark, sf, "note_watermarks"), "source", "created_time", strict=False,
                            default_ts=ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
    return out.select("id")


@register("sync_rated", uses=("rated_pages",), sql=f"""
SELECT id, arrival, source, CAST(user_rating AS INTEGER) AS user_rating, {_TS("last_edited_time")} AS last_edited_time FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
  WHERE user_rating IS NOT NULL AND user_rating <> '')
WHERE rn = 1""")
def sync_rated(spark, sf):
    """Drop unrated versions, newest version per page wins."""
    p = binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time")
    out = SC.sync_rated(p)
    return out.select("id", "arrival", "source", F.col("user_rating").cast("int").alias("user_rating"),
                      ts_text("last_edited_time").alias("last_edited_time"))


@register("subscription_pull", uses=("subscriptions",), sql="""
, s AS (SELECT member, unnest(list_names) AS list_name FROM subscriptions WHERE enabled)
, j AS (SELECT s.list_name, s.member, o.o_orderkey,
               row_number() OVER (PARTITION BY s.list_name, s.member ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
        FROM s JOIN orders o ON o.o_custkey = s.member)
SELECT list_name, member, o_orderkey FROM j WHERE rn <= 3""")
def subscription_pull(spark, sf):
    """Per list and member, the newest 3 entries of the member."""
    s = SC.enabled(binding(spark, sf, "subscriptions")).select("member", F.explode("list_names").alias("list_name"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    j = s.join(o, s["member"] == o["o_custkey"])
    head = SC.head_per_group(j, ["list_name", "member"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3)
    return head.select("list_name", "member", "o_orderkey")


@register("lookup_index", uses=("customer_regions", "index_pages"), sql="""
SELECT c.c_custkey, coalesce(i.index_id, '') AS index_id
FROM customer_regions c LEFT JOIN index_pages i ON c.category = i.category AND c.name = i.name""")
def lookup_index(spark, sf):
    """(category, name) -> index id; a missing category gives ''."""
    c = binding(spark, sf, "customer_regions")
    out = SC.lookup_index(c, binding(spark, sf, "index_pages"), F.col("category"), F.col("name"))
    return out.select("c_custkey", "index_id")


@register("subs_by_list", uses=("subscriptions",), sql="""
SELECT list_name, CAST(count(DISTINCT member) AS BIGINT) AS n_members
FROM (SELECT member, unnest(list_names) AS list_name FROM subscriptions WHERE enabled) GROUP BY list_name""")
def subs_by_list(spark, sf):
    """Members per list (as counts; the grouping itself stays as rows keyed by list)."""
    return SC.members_per_list(SC.enabled(binding(spark, sf, "subscriptions")))


@register("list_members", uses=("subscriptions",), sql="""
SELECT DISTINCT list_name, member FROM (SELECT member, unnest(list_names) AS list_name FROM subscriptions WHERE enabled)""")
def list_members(spark, sf):
    """The members of each list, a row per (list, member)."""
    return SC.list_members(SC.enabled(binding(spark, sf, "subscriptions")))


@register("stream_newest_versions", uses=(), sql="""
, o AS (SELECT user_id, event_id, event_type, ts, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS tie FROM events WHERE ts IS NOT NULL)
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, tie DESC) AS rn FROM o
        WHERE epoch_ms(ts) >= (SELECT epoch_ms(max(ts)) FROM o) - 2592000000)
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE rn = 1""")
def stream_newest_versions(spark, sf):
    """The events as a stream; each user's newest event of the 30 days before the newest one of all."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/newest-{uuid.uuid4().hex}"
    events = micro.read_files(spark, f"{sf}/events*.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    changes = stateful.newest_versions(events, "user_id", "ts", ["event_id", "event_type"], "30 days")
    stateful.write_changes(changes, f"{folder}/rows", f"{folder}/checkpoint")
    written = SC.read_snapshot(spark, f"{folder}/rows", changes.schema, "parquet").drop("batch")
    now = stateful.current_versions(written, "user_id")
    return now.select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@register("dedup_within_ttl", uses=("versions",), recursive=True, sql=f"""
, o AS (SELECT page_id, arrival, last_edited,
               CAST(row_number() OVER (PARTITION BY page_id ORDER BY last_edited, arrival) AS INTEGER) AS i FROM versions)
, ch(page_id, i, last_kept, kept, arrival, last_edited) AS (
    SELECT page_id, i, last_edited, true, arrival, last_edited FROM o WHERE i = 1
    UNION ALL
    SELECT o.page_id, o.i,
           CASE WHEN o.last_edited >= ch.last_kept + INTERVAL 1 DAY THEN o.last_edited ELSE ch.last_kept END,
           o.last_edited >= ch.last_kept + INTERVAL 1 DAY, o.arrival, o.last_edited
    FROM ch JOIN o ON o.page_id = ch.page_id AND o.i = ch.i + 1)
SELECT page_id, arrival, {_TS("last_edited")} AS last_edited FROM ch WHERE kept""")
def dedup_within_ttl(spark, sf):
    """Per page, versions inside the 1-day TTL of the last kept version are dropped (recursive-SQL oracle)."""
    v = binding(spark, sf, "versions").select("page_id", "arrival", "last_edited")
    out = D.dedup_within_ttl(v, "page_id", "last_edited", 24 * 3600, tiebreak=["arrival"])
    return out.select("page_id", "arrival", ts_text("last_edited").alias("last_edited"))
