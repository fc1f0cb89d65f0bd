"""Composite jobs (C1-C12) over the fixture tables.

These chain operators that are oracle-checked one by one; the chains
themselves are checked for internal consistency in ``tests/test_jobs.py``
(rows-only in the driver's gate).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import RUN_DATE, RUN_TS, ts
from feedsift.functions.labels import render_labels
from feedsift.operators.common import bounded_broadcast
from feedsift.operators.dedup import anti_join_visited
from feedsift.operators.filters import parse_overrides
from feedsift.operators.state import since_watermark
from feedsift.catalog.q_normalise import _AUTHOR, _PF, _URL, raw_posts
from feedsift.catalog.q_text import _central_sql, _classifier_sql, _embed_ctes, _separator_chunks_sql, _summary_sql, _todo_rows_sql, rank_classifier
from feedsift.plans import jobs as J
from feedsift.session import ensure_checkpoint_dir
from feedsift.sources.blocks import blocks_to_text
from feedsift.sources.normalise import normalise_posts as normalise_raw
from feedsift.sources.transcripts import resolve_transcripts

OVERRIDES = "src0:3,src3:4.5,bad,src5:0"


def _rated(spark, sf):
    """Rated documents as the vector collection and its metadata (ratings from ``labels``)."""
    ratings = binding(spark, sf, "ratings")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rated_docs = docs.join(bounded_broadcast(ratings), docs["doc_id"] == ratings["page_id"]).select(F.col("doc_id").alias("id"), "text")
    vectors = J.rated_vectors_of(rated_docs, F.col("text"))
    meta = ratings.select(F.col("page_id").alias("item_id"), "user_rating")
    return vectors, meta


def _curate(spark, sf):
    items = binding(spark, sf, "items").select("id", "list_name", "title", "body")
    vectors, meta = _rated(spark, sf)
    return J.curate(items, binding(spark, sf, "visited"), vectors, meta, overrides=parse_overrides(spark, OVERRIDES), model=rank_classifier(spark, sf))


_OVR = (", o AS (SELECT split_part(e, ':', 1) AS list_name, CAST(split_part(e, ':', 2) AS DOUBLE) AS min_score "
        f"FROM (SELECT unnest(string_split('{OVERRIDES}', ',')) AS e) WHERE len(string_split(e, ':')) >= 2)")

# The whole C1 chain in SQL: dedup -> embedding -> exact KNN (squared L2, k=2, <= 0.5) -> mean rating ->
# per-list threshold -> rank gate.
_CURATE = """
, rated_docs AS MATERIALIZED (SELECT d.doc_id AS id, d.text FROM documents d JOIN ratings r ON d.doc_id = r.page_id)
, fresh AS MATERIALIZED (SELECT i.* FROM items i LEFT JOIN visited v ON v.item_id = i.id AND v.list_name = i.list_name
                         WHERE v.item_id IS NULL)
, qtext AS MATERIALIZED (SELECT id, list_name || ' ' || title || ': ' || body AS t FROM fresh)""" \
    + _embed_ctes("r", "rated_docs", "id", "text") + _embed_ctes("q", "qtext", "id", "t") + """
, pairs AS (SELECT q.key AS query_id, r.key AS item_id,
                   round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
            FROM q, r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM pairs)
, kept AS (SELECT k.query_id, m.user_rating FROM ranked k JOIN ratings m ON k.item_id = m.page_id
           WHERE k.rnk <= 2 AND k.distance <= 0.5)
, scores AS (SELECT f.id, coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0) AS relevant_score
             FROM fresh f LEFT JOIN kept ON f.id = kept.query_id GROUP BY f.id)""" + _OVR + """
, passed AS (SELECT f.id, f.list_name, f.title || ': ' || f.body AS content, s.relevant_score
             FROM fresh f JOIN scores s ON f.id = s.id LEFT JOIN o ON f.list_name = o.list_name
             WHERE s.relevant_score < 0 OR s.relevant_score >= coalesce(nullif(o.min_score, 0), 4.0))
, g AS MATERIALIZED (SELECT p.*, f.body, (p.relevant_score > 0 AND p.relevant_score < 4) AS gated FROM passed p JOIN fresh f ON p.id = f.id)"""


@register("curate_posts", uses=("items", "visited", "ratings", "rank_training"), sql=_CURATE + """
, todo AS MATERIALIZED (SELECT id, body FROM g WHERE NOT gated)""" + _classifier_sql("nb", "todo", "id", "body") + """
SELECT g.id, list_name, round(relevant_score, 6) AS relevant_score,
  CASE WHEN gated THEN -0.02 ELSE coalesce(nullif(quality, 0), -0.01) END AS rate,
  CASE WHEN gated THEN '' ELSE topic || ':' || printf('%.6f', score) END AS topics,
  NOT gated AS ranked
FROM g LEFT JOIN nb ON g.id = nb.k""")
def curate_posts(spark, sf):
    """Dedup -> KNN score against rated documents -> per-list threshold -> gate/classify -> top-3 labels."""
    p = _curate(spark, sf).published
    return p.select("id", "list_name", F.round("relevant_score", 6).alias("relevant_score"), F.round("rate", 6).alias("rate"),
                    render_labels("topics").alias("topics"), "ranked")


@register("curate_funnel", uses=("items", "visited", "ratings"), sql=_CURATE + """
, c AS (SELECT i.list_name, count(*) AS total_input, count(f.id) AS post_deduping, count(f.id) AS post_scoring,
               count(g.id) AS post_filtering, count(g.id) AS post_summary, count_if(coalesce(NOT g.gated, false)) AS post_ranking,
               count(g.id) AS total_pushed
        FROM items i LEFT JOIN fresh f ON i.id = f.id LEFT JOIN g ON i.id = g.id GROUP BY i.list_name)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM c
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))""")
def curate_funnel(spark, sf):
    """The seven stage counters per list for the same run."""
    return _curate(spark, sf).funnel


_FEED = """
, head AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY id) AS rn FROM items) WHERE rn <= 3)
, rated_docs AS MATERIALIZED (SELECT d.doc_id AS id, d.text FROM documents d JOIN ratings r ON d.doc_id = r.page_id)
, fresh AS MATERIALIZED (SELECT h.* FROM head h LEFT JOIN visited v ON v.item_id = h.id AND v.list_name = h.list_name
                         WHERE v.item_id IS NULL)
, qtext AS MATERIALIZED (SELECT id, title || ' - ' || list_name || ' - ' || body AS t FROM fresh)""" \
    + _embed_ctes("r", "rated_docs", "id", "text") + _embed_ctes("q", "qtext", "id", "t") + """
, pairs AS (SELECT q.key AS query_id, r.key AS item_id,
                   round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
            FROM q, r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM pairs)
, kept AS (SELECT k.query_id, m.user_rating FROM ranked k JOIN ratings m ON k.item_id = m.page_id
           WHERE k.rnk <= 2 AND k.distance <= 0.5)
, scores AS (SELECT f.id, f.list_name, f.title, f.body, coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0) AS relevant_score
             FROM fresh f LEFT JOIN kept ON f.id = kept.query_id GROUP BY f.id, f.list_name, f.title, f.body)
, top AS (SELECT * FROM scores WHERE relevant_score < 0 OR relevant_score >= 4 ORDER BY relevant_score DESC, id LIMIT 1)
""" + _summary_sql("top", "id", "body") + """
SELECT t.id, t.list_name, round(t.relevant_score, 6) AS relevant_score, coalesce(ms.summary, '') AS summary,
       array_to_string(string_split(t.title, ' ')[1:3], '|') AS tags
FROM top t LEFT JOIN msum ms ON t.id = ms.k"""


@register("curate_feed", uses=("items", "visited", "ratings"), sql=_FEED)
def curate_feed(spark, sf):
    """C4: first 3 entries per feed -> dedup -> score -> global top 1 -> map-reduce summary -> first tags."""
    items = binding(spark, sf, "items").select("id", "list_name", "title", "body").withColumn("pos", F.col("id"))
    vectors, meta = _rated(spark, sf)
    out = J.feeds(items, binding(spark, sf, "visited"), vectors, meta).published
    return out.select("id", "list_name", F.round("relevant_score", 6).alias("relevant_score"), "summary",
                      F.array_join("tags", "|").alias("tags"))


_DIGEST_SQL = """
, lat AS MATERIALIZED (SELECT id, arg_max_null(take_aways, last_edited_time) AS text,
                              CAST(arg_max_null(user_rating, last_edited_time) AS INTEGER) AS user_rating
                       FROM rated_pages GROUP BY id)
, meta AS (SELECT id AS item_id, user_rating FROM lat WHERE user_rating IS NOT NULL)
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '' AND last_edited_time >= TIMESTAMP '{RUN_TS}' - INTERVAL 7 DAY) WHERE rn = 1)
, body AS (SELECT CAST(page_id AS VARCHAR) AS id, string_agg(CASE type WHEN 'bulleted_list_item' THEN '- ' || text || chr(10)
               WHEN 'numbered_list_item' THEN '1. ' || text || chr(10) WHEN 'code' THEN '```' || text || '```' ELSE text END || chr(10), '' ORDER BY pos) AS page_text
           FROM blocks GROUP BY page_id)
, pages AS MATERIALIZED (SELECT id, source, CAST(user_rating AS INTEGER) AS user_rating, take_aways,
                                id || ': ' || coalesce(page_text, '') || CASE WHEN coalesce(take_aways, '') <> '' THEN chr(10) || 'Take aways: ' || take_aways ELSE '' END AS t
                         FROM latest LEFT JOIN body USING (id) WHERE CAST(user_rating AS INTEGER) >= 4 OR coalesce(take_aways, '') <> '')""".replace("{RUN_TS}", RUN_TS) \
    + _embed_ctes("r", "lat", "id", "text") + _embed_ctes("q", "pages", "id", "t") + """
, pairs AS (SELECT q.key AS query_id, r.key AS item_id,
                   round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
            FROM q, r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM pairs)
, kept AS (SELECT k.query_id, m.user_rating FROM ranked k JOIN meta m ON k.item_id = m.item_id
           WHERE k.rnk <= 4 AND k.distance <= 0.5 AND k.item_id <> k.query_id)
, scored AS (SELECT p.id, p.source, p.user_rating, coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0) AS relevant
             FROM pages p LEFT JOIN kept ON p.id = kept.query_id GROUP BY p.id, p.source, p.user_rating)
, digest AS (SELECT * FROM scored WHERE user_rating * 0.8 + relevant * 0.2 >= 4.5 ORDER BY relevant DESC, id LIMIT 10)
SELECT source, CAST(count(*) AS BIGINT) AS n_pages,
       '## ' || source || chr(10) || string_agg('- ' || id, chr(10) ORDER BY relevant DESC, id) AS section
FROM digest GROUP BY source"""


@register("weekly_digest", uses=("rated_pages", "blocks"), sql=_DIGEST_SQL)
def weekly_digest(spark, sf):
    """Pages of the last seven days with their block text, scored against the rated collection (k=4, self excluded), post-filtered, by source."""
    pages = binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time",
                                                     "take_aways", "tags")
    latest = pages.groupBy("id").agg(F.max_by("take_aways", "last_edited_time").alias("text"),
                                     F.max_by("user_rating", "last_edited_time").cast("int").alias("user_rating"))
    vectors = J.rated_vectors_of(latest, F.col("text"))
    meta = latest.where(F.col("user_rating").isNotNull()).select(F.col("id").alias("item_id"), "user_rating")
    texts = blocks_to_text(binding(spark, sf, "blocks"), separator="\n").select(F.col("page_id").cast("string").alias("id"), F.col("text").alias("page_text"))
    out = J.weekly_digest(pages, vectors, meta, page_texts=texts, now=ts(RUN_TS))
    return out["sections"]


@register("daily_journal", uses=("notes", "note_watermarks"), sql=f"""
, pulled AS (SELECT n.* FROM notes n LEFT JOIN note_watermarks w ON n.source = w.source
             WHERE n.created_time > coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 365 DAY))
, r AS (SELECT CAST(created_time AS DATE) AS day, count(*) AS n,
               string_agg(title || ' ' || content || chr(10), '' ORDER BY created_time, id) AS text
        FROM pulled GROUP BY CAST(created_time AS DATE))
SELECT day, CAST(n AS BIGINT) AS n_notes, 'S:' || md5('title|S:' || md5('rewrite|' || text)) AS title,
       'S:' || md5('summary|S:' || md5('rewrite|' || text)) AS summary
FROM r""")
def daily_journal(spark, sf):
    """Notes after the watermark -> day roll-up -> rewrite and five passes over it (one row per day)."""
    out = J.daily_journal(binding(spark, sf, "notes"), binding(spark, sf, "note_watermarks"), run_ts=ts(RUN_TS))
    return out["refined"].select("day", "n_notes", F.col("refined.title").alias("title"),
                                 F.col("refined.summary").alias("summary"))


@register("todo_actions", uses=("rated_pages", "todo_state"), sql="""
, pages AS (SELECT p.id, p.take_aways FROM rated_pages p LEFT JOIN todo_state s ON p.id = CAST(s.page_id AS VARCHAR)
            WHERE (s.page_id IS NULL OR p.last_edited_time IS DISTINCT FROM s.last_edited)
              AND p.source NOT IN ('error', 'signup') AND NOT list_contains(p.tags, 'action:deepdive')
              AND length(coalesce(p.take_aways, '')) > 0)
, gen AS (SELECT id, 'Action Items' || chr(10) || '1. ' || substr(md5(take_aways), 1, 8) || chr(10) || '2. None' AS todo,
                 'T' || chr(10) || '1. ' || substr(md5('tr|' || take_aways), 1, 8) || chr(10) || '2. None' AS todo_trans
          FROM pages)
""" + _todo_rows_sql("gen"))
def todo_actions(spark, sf):
    """Changed pages (version inequality) -> exclusions -> take-aways -> action rows."""
    pages = binding(spark, sf, "rated_pages").select("id", "source", "last_edited_time", "take_aways", "tags")
    state = binding(spark, sf, "todo_state").select(F.col("page_id").cast("string").alias("id"),
                                                    F.col("last_edited").alias("last_edited_time"))
    return J.todo_actions(pages, state, excluded_sources=["error", "signup"])


_VECTOR_SQL = "array_to_string(list_transform(e, lambda x: CAST(CAST(round(x * 10000) AS INTEGER) AS VARCHAR)), ' ')"


def vector_text(name):
    """A vector's values in ten-thousandths, as text."""
    return F.array_join(F.transform(name, lambda x: F.round(x.cast("double") * 10000).cast("int").cast("string")), " ").alias("vector")


@register("sync_and_index", uses=("rated_pages", "visited"), sql="""
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '') WHERE rn = 1)
, fresh AS MATERIALIZED (SELECT id, coalesce(take_aways, '') AS t FROM latest WHERE id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM visited))
""" + _embed_ctes("v", "fresh", "id", "t") + """
SELECT key AS item_id, DATE '{RUN_DATE}' AS as_of, 'hashing' AS model, """.replace("{RUN_DATE}", RUN_DATE) + _VECTOR_SQL + """ AS vector FROM v""")
def sync_and_index(spark, sf):
    """Newest rated version per page, new/changed split, vector rows for the run date's collection."""
    pages = binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time",
                                                     "take_aways")
    visited = binding(spark, sf, "visited").select(F.col("item_id").cast("string").alias("item_id"))
    state = binding(spark, sf, "page_state").select(F.col("page_id").cast("string").alias("page_id"), "user_rating")
    out = J.sync_and_index(pages, visited, state, run_date=RUN_DATE)
    return out["vectors"].select("item_id", "as_of", "model", vector_text("embedding"))


@register("curate_articles", uses=("notes", "note_watermarks", "visited", "rank_training"), sql="""
, pulled AS (SELECT n.* FROM notes n LEFT JOIN note_watermarks w ON n.source = w.source
             WHERE n.created_time >= coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY))
, fresh AS MATERIALIZED (SELECT * FROM pulled WHERE id NOT IN (SELECT item_id FROM visited))
""".replace("{RUN_TS}", RUN_TS) + _summary_sql("fresh", "id", "content") + """
, g AS MATERIALIZED (SELECT f.id, f.source, coalesce(ms.summary, '') AS summary FROM fresh f LEFT JOIN msum ms ON f.id = ms.k)""" + _classifier_sql("nb", "g", "id", "summary") + """
SELECT id, source, summary, quality AS rate, topic || ':' || printf('%.6f', score) AS topics FROM g JOIN nb ON g.id = nb.k""")
def curate_articles(spark, sf):
    """Inbox pages since their source's watermark -> dedup -> map-reduce summary -> classify -> top labels."""
    notes = binding(spark, sf, "notes")
    visited = binding(spark, sf, "visited").select("item_id")
    out = J.articles(notes, binding(spark, sf, "note_watermarks"), visited, run_ts=ts(RUN_TS), model=rank_classifier(spark, sf)).published
    return out.select("id", "source", "summary", F.round("rate", 6).alias("rate"), render_labels("topics").alias("topics"))


@register("articles_funnel", uses=("notes", "note_watermarks", "visited"), sql="""
, pulled AS (SELECT n.* FROM notes n LEFT JOIN note_watermarks w ON n.source = w.source
             WHERE n.created_time >= coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY))
, c AS (SELECT source AS list_name, count(*) AS total_input, count(*) FILTER (id NOT IN (SELECT item_id FROM visited)) AS n FROM pulled GROUP BY source)
, k AS (SELECT list_name, total_input, n AS post_deduping, n AS post_scoring, n AS post_filtering, n AS post_summary, n AS post_ranking, n AS total_pushed FROM c)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM k
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))""".replace("{RUN_TS}", RUN_TS))
def articles_funnel(spark, sf):
    """The seven stage counters of the articles job, counted by the action that publishes (no pass of their own)."""
    notes = binding(spark, sf, "notes")
    out = J.articles(notes, binding(spark, sf, "note_watermarks"), binding(spark, sf, "visited").select("item_id"), run_ts=ts(RUN_TS), model=rank_classifier(spark, sf))
    return _published_funnel(spark, out, notes.select("source").distinct())


def _published_funnel(spark, out, groups):
    """Publish a job's rows into the shared folder; its counters as seen by that action, for the groups that had input."""
    names = sorted(r[0] for r in groups.collect())                  # the configured sources or lists
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
    counts = out.publish(path, names)["funnel"]
    with_input = {g for g, stage, n in counts if stage == "total_input" and n}
    return spark.createDataFrame([x for x in counts if x[0] in with_input], "list_name string, stage string, n long")


_HEARD = """
, pulled AS MATERIALIZED (SELECT v.* FROM videos v LEFT JOIN video_watermarks w ON v.source = w.source WHERE v.created_time >= coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY))
, fresh AS MATERIALIZED (SELECT * FROM pulled WHERE id NOT IN (SELECT item_id FROM videos_seen))
, cached AS (SELECT item_id, max(value) AS value FROM transcript_cache WHERE expires_at > TIMESTAMP '{RUN_TS}' AND value <> '' GROUP BY item_id)
, spoken AS (SELECT video_id, lang, string_agg(coalesce(text, '') || chr(10), '' ORDER BY part NULLS FIRST, coalesce(text, '')) AS t, list_position(['en', 'fr'], lang) AS p
             FROM video_tracks WHERE lang IN ('en', 'fr') GROUP BY video_id, lang)
, tracked AS (SELECT video_id, arg_min(lang, p) AS lang, arg_min(t, p) AS t FROM spoken GROUP BY video_id)
, said AS MATERIALIZED (SELECT f.*, CASE WHEN contains(url, 'twitch.tv') THEN 'excluded' WHEN c.value IS NOT NULL THEN 'cache' ELSE coalesce(t.lang, 'none') END AS via,
    CASE WHEN contains(url, 'twitch.tv') THEN '' ELSE coalesce(c.value, t.t, '') END AS transcript
  FROM fresh f LEFT JOIN cached c ON c.item_id = f.id LEFT JOIN tracked t ON t.video_id = f.id)""".replace("{RUN_TS}", RUN_TS)


def _summary_or_key_sql(src, key, text):
    """``ss(k, summary, used)``: the map-reduce summary of ``src``, or the text's key sentences where no sentences share a word."""
    return _separator_chunks_sql("mc", src, key, text, 2048, 256) + """
, mk AS (SELECT CAST(k AS VARCHAR) || '|' || CAST(chunk_no AS VARCHAR) AS ck, k, chunk_no, chunk FROM mc)""" + _central_sql("mm", "mk", "ck", "chunk") + """
, mj AS (SELECT mk.k AS jk, string_agg(CASE WHEN mm.linked THEN mm.summary ELSE '' END, chr(10) || chr(10) ORDER BY chunk_no) AS joined FROM mk LEFT JOIN mm ON mk.ck = mm.k GROUP BY mk.k)""" \
        + _central_sql("ms", "mj", "jk", "joined") + _central_sql("hk", src, key, text) + f"""
, ss AS MATERIALIZED (SELECT s.{key} AS k, CASE WHEN ms.linked THEN ms.summary ELSE coalesce(hk_key.summary, '') END AS summary,
    CASE WHEN ms.linked THEN 'central-sentences' ELSE 'key-sentences' END AS used
  FROM {src} s LEFT JOIN ms ON ms.k = s.{key} LEFT JOIN hk_key ON hk_key.k = s.{key})"""


_VIDEO_TABLES = ("videos", "video_watermarks", "videos_seen", "video_tracks", "transcript_cache")


def _videos(spark, sf):
    v, w, seen, tracks, cache = (binding(spark, sf, x) for x in _VIDEO_TABLES)
    return J.videos(v, w, tracks, cache, run_ts=ts(RUN_TS), langs=["en", "fr"], visited=seen, model=rank_classifier(spark, sf))


@register("video_transcripts", uses=_VIDEO_TABLES, sql=_HEARD + """
SELECT id, via, transcript, via NOT IN ('excluded', 'cache') AS to_cache FROM said""")
def video_transcripts(spark, sf):
    """Transcripts of new videos: excluded sites, the cache, the first preferred language, and what the cache gains."""
    v, w, seen, tracks, cache = (binding(spark, sf, x) for x in _VIDEO_TABLES)
    pulled = since_watermark(v, w, "source", "created_time", strict=False, default_ts=ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
    heard, new = resolve_transcripts(anti_join_visited(pulled, seen, {"id": "item_id"}), tracks, cache, ["en", "fr"], now=ts(RUN_TS), ttl_seconds=604_800)
    kept = new.select(F.col("item_id").alias("id"), F.col("value").alias("_value"))
    return heard.join(kept, "id", "left").select("id", "via", "transcript", F.col("_value").eqNullSafe(F.col("transcript")).alias("to_cache"))


@register("curate_videos", uses=(*_VIDEO_TABLES, "rank_training"), sql=_HEARD + """
, heard AS MATERIALIZED (SELECT * FROM said WHERE transcript <> '')""" + _summary_or_key_sql("heard", "id", "transcript") + """
, g AS MATERIALIZED (SELECT h.id, h.source, h.via, ss.summary, ss.used FROM heard h JOIN ss ON ss.k = h.id)""" + _classifier_sql("nb", "g", "id", "summary") + """
SELECT id, source, via, summary, used, quality AS rate, topic || ':' || printf('%.6f', score) AS topics FROM g JOIN nb ON g.id = nb.k""")
def curate_videos(spark, sf):
    """New videos -> transcript (S21) -> map-reduce summary (M3), fallback model (M6) -> classify -> top labels."""
    out = _videos(spark, sf).published
    return out.select("id", "source", "via", "summary", "used", F.round("rate", 6).alias("rate"), render_labels("topics").alias("topics"))


@register("videos_funnel", uses=_VIDEO_TABLES, sql=_HEARD + """
, c AS (SELECT p.source AS list_name, count(*) AS total_input, count(s.id) AS fresh, count(s.id) FILTER (s.transcript <> '') AS n FROM pulled p LEFT JOIN said s ON s.id = p.id GROUP BY p.source)
, k AS (SELECT list_name, total_input, fresh AS post_deduping, fresh AS post_scoring, n AS post_filtering, n AS post_summary, n AS post_ranking, n AS total_pushed FROM c)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM k
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))""")
def videos_funnel(spark, sf):
    """The videos published, with the seven counters of each source seen by that one action."""
    return _published_funnel(spark, _videos(spark, sf), binding(spark, sf, "videos").select("source").distinct())


_SHORT_POSTS = """
, said AS MATERIALIZED (SELECT p.list_name, p.id, p.name, p.reply_to IS NOT NULL AND t.id IS NULL AS reply_deleted,
    CASE WHEN coalesce(t.text, '') <> '' THEN t.name || ': ' || t.text ELSE '' END || p.name || ': ' || p.text AS body
  FROM list_posts p LEFT JOIN list_posts t ON t.list_name = p.list_name AND t.id = p.reply_to)
, fresh AS MATERIALIZED (SELECT s.* FROM said s LEFT JOIN posts_read v ON v.item_id = s.id AND v.list_name = s.list_name WHERE v.item_id IS NULL)
, rated_docs AS MATERIALIZED (SELECT d.doc_id AS id, d.text FROM documents d JOIN ratings r ON d.doc_id = r.page_id)""" \
    + _embed_ctes("r", "rated_docs", "id", "text") + _embed_ctes("q", "fresh", "id", "body") + """
, pairs AS (SELECT q.key AS query_id, r.key AS item_id,
                   round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
            FROM q, r)
, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM pairs)
, kept AS (SELECT k.query_id, m.user_rating FROM near k JOIN ratings m ON k.item_id = m.page_id WHERE k.rnk <= 2 AND k.distance <= 0.5)
, scores AS (SELECT f.id, coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0) AS relevant_score FROM fresh f LEFT JOIN kept ON f.id = kept.query_id GROUP BY f.id)
, g AS MATERIALIZED (SELECT f.*, relevant_score, relevant_score > 0 AND relevant_score < 4 AS gated FROM fresh f JOIN scores s ON f.id = s.id
  WHERE relevant_score < 0 OR relevant_score >= CASE WHEN f.list_name = 'tech' THEN 3.0 ELSE 4.0 END)"""


def _short_posts(spark, sf):
    vectors, meta = _rated(spark, sf)
    return J.short_posts(binding(spark, sf, "list_posts"), binding(spark, sf, "posts_read"), vectors, meta, model=rank_classifier(spark, sf), overrides=parse_overrides(spark, "tech:3"))


@register("curate_short_posts", uses=("list_posts", "posts_read", "ratings", "rank_training"), sql=_SHORT_POSTS + """
, todo AS MATERIALIZED (SELECT id, body FROM g WHERE NOT gated)""" + _classifier_sql("nb", "todo", "id", "body") + """
SELECT g.id, list_name, reply_deleted, round(relevant_score, 6) AS relevant_score, CASE WHEN gated THEN -0.02 ELSE coalesce(nullif(quality, 0), -0.01) END AS rate,
  CASE WHEN gated THEN '' ELSE topic || ':' || printf('%.6f', score) END AS topics, NOT gated AS ranked
FROM g LEFT JOIN nb ON g.id = nb.k""")
def curate_short_posts(spark, sf):
    """Short posts with the post they answer -> dedup -> score of both texts -> per-list threshold -> gate/classify -> top labels."""
    p = _short_posts(spark, sf).published
    return p.select("id", "list_name", "reply_deleted", F.round("relevant_score", 6).alias("relevant_score"), F.round("rate", 6).alias("rate"), render_labels("topics").alias("topics"), "ranked")


@register("short_posts_funnel", uses=("list_posts", "posts_read", "ratings"), sql=_SHORT_POSTS + """
, c AS (SELECT p.list_name, count(*) AS total_input, count(f.id) AS post_deduping, count(f.id) AS post_scoring, count(g.id) AS post_filtering,
               count(g.id) AS post_summary, count_if(coalesce(NOT g.gated, false)) AS post_ranking, count(g.id) AS total_pushed
        FROM list_posts p LEFT JOIN fresh f ON p.id = f.id LEFT JOIN g ON p.id = g.id GROUP BY p.list_name)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM c
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))""")
def short_posts_funnel(spark, sf):
    """The short posts published, with the seven counters of each list seen by that one action."""
    return _published_funnel(spark, _short_posts(spark, sf), binding(spark, sf, "list_posts").select("list_name").distinct())


_POSTS = f"""
, p AS MATERIALIZED (SELECT md5(concat_ws('_', subreddit, title, {_AUTHOR}, {_PF})) AS id, subreddit AS list_name, title, text, num_comments, has_media, {_URL} AS u FROM posts)
, fresh AS MATERIALIZED (SELECT *, list_name || ' ' || title || ': ' || text AS t FROM p WHERE num_comments <> 3)
, rated_docs AS MATERIALIZED (SELECT d.doc_id AS id, d.text FROM documents d JOIN ratings r ON d.doc_id = r.page_id)""" \
    + _embed_ctes("r", "rated_docs", "id", "text") + _embed_ctes("q", "fresh", "id", "t") + """
, pairs AS (SELECT q.key AS query_id, r.key AS item_id,
                   round(greatest(list_inner_product(q.e, q.e) + list_inner_product(r.e, r.e) - 2 * list_inner_product(q.e, r.e), 0), 6) AS distance
            FROM q, r)
, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item_id) AS rnk FROM pairs)
, kept AS (SELECT k.query_id, m.user_rating FROM near k JOIN ratings m ON k.item_id = m.page_id WHERE k.rnk <= 2 AND k.distance <= 0.5)
, scores AS (SELECT f.id, coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0) AS relevant_score FROM fresh f LEFT JOIN kept ON f.id = kept.query_id GROUP BY f.id)
, g AS MATERIALIZED (SELECT f.*, relevant_score, relevant_score > 0 AND relevant_score < 4 AS gated FROM fresh f JOIN scores s ON f.id = s.id
  WHERE relevant_score < 0 OR relevant_score >= CASE list_name WHEN 'user' THEN 3.0 WHEN 'system' THEN 2.0 ELSE 4.0 END)"""
_POST_RATES = """
, todo AS MATERIALIZED (SELECT id, text FROM g WHERE NOT gated)""" + _classifier_sql("nb", "todo", "id", "text") + """
, rated AS (SELECT g.*, CASE WHEN gated THEN -0.02 ELSE coalesce(nullif(quality, 0), -0.01) END AS rate, CASE WHEN gated THEN '' ELSE topic || ':' || printf('%.6f', score) END AS topics FROM g LEFT JOIN nb ON g.id = nb.k)"""


def _posts(spark, sf):
    """C5 over the stored posts; those with three comments have been read, those with five have a cached summary."""
    raw = raw_posts(binding(spark, sf, "posts"))
    known = normalise_raw(raw)
    seen = known.where("num_comments = 3").select(F.col("id").alias("item_id"), F.col("subreddit").alias("list_name"))
    kept = known.where("num_comments = 5").select(F.col("id").alias("item_id"), F.concat(F.lit("kept: "), "title").alias("value"))
    vectors, meta = _rated(spark, sf)
    return J.posts(raw, seen, vectors, meta, kept, overrides=parse_overrides(spark, "user:3,system:2"), model=rank_classifier(spark, sf))


@register("publish_posts", uses=("posts", "ratings", "rank_training"), sql=_POSTS + """
, unread AS MATERIALIZED (SELECT id, text FROM g WHERE num_comments <> 5)""" + _summary_or_key_sql("unread", "id", "text") + _POST_RATES + """
SELECT r.id, list_name, round(relevant_score, 6) AS relevant_score, CASE WHEN num_comments = 5 THEN 'kept: ' || title ELSE ss.summary END AS summary,
  CASE WHEN num_comments = 5 THEN 'cached' ELSE ss.used END AS used, rate, topics, NOT gated AS ranked,
  CASE WHEN has_media OR contains(u, 'https://v.redd.it') THEN 'video|' WHEN suffix(u, 'jpg') OR suffix(u, 'png') OR suffix(u, 'gif') OR contains(u, 'https://i.redd.it') THEN 'image|'
       WHEN contains(u, 'www.reddit.com/gallery') THEN 'gallery|' WHEN NOT contains(u, 'https://www.reddit.com') AND NOT contains(u, '.redd.it') THEN 'bookmark|' ELSE '' END
    || 'quote|summary|permalink|metadata' AS blocks
FROM rated r LEFT JOIN ss ON ss.k = r.id""")
def publish_posts(spark, sf):
    """Stored posts -> normalise -> dedup -> score -> threshold -> summary (cache, map-reduce, fallback) -> classify -> body blocks."""
    p = _posts(spark, sf).published
    return p.select("id", "list_name", F.round("relevant_score", 6).alias("relevant_score"), "summary", "used", F.round("rate", 6).alias("rate"),
                    render_labels("topics").alias("topics"), "ranked", F.array_join("blocks", "|").alias("blocks"))


@register("posts_rates", uses=("posts", "ratings", "rank_training"), sql=_POSTS + _POST_RATES + """
, b AS (SELECT list_name, CASE WHEN rate <= 0.5 THEN 'below_0.5' WHEN rate <= 0.6 THEN 'below_0.6' WHEN rate <= 0.7 THEN 'below_0.7'
                               WHEN rate <= 0.8 THEN 'below_0.8' WHEN rate <= 0.9 THEN 'below_0.9' ELSE 'below_1' END AS bucket FROM rated WHERE rate <= 1)
SELECT list_name, bucket, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""")
def posts_rates(spark, sf):
    """The histogram of the published posts' rates."""
    return _posts(spark, sf).rates


@register("posts_funnel", uses=("posts", "ratings"), sql=_POSTS + """
, c AS (SELECT p.list_name, count(*) AS total_input, count(f.id) AS post_deduping, count(f.id) AS post_scoring, count(g.id) AS post_filtering,
               count(g.id) AS post_summary, count_if(coalesce(NOT g.gated, false)) AS post_ranking, count(g.id) AS total_pushed
        FROM p LEFT JOIN fresh f ON p.id = f.id LEFT JOIN g ON p.id = g.id GROUP BY p.list_name)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM c
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))""")
def posts_funnel(spark, sf):
    """The posts published, with the seven counters of each list seen by that one action."""
    return _published_funnel(spark, _posts(spark, sf), binding(spark, sf, "posts").select(F.col("subreddit").alias("list_name")).distinct())


_RESEARCH_SQL = """
, lat AS (SELECT id, arg_max_null(take_aways, last_edited_time) AS take_aways, arg_max_null(tags, last_edited_time) AS tags
          FROM rated_pages GROUP BY id)
, chosen AS MATERIALIZED (SELECT * FROM lat WHERE id NOT IN (SELECT CAST(page_id AS VARCHAR) FROM todo_state)
                          AND length(coalesce(take_aways, '')) > 0 AND list_contains(tags, 'action:deepdive'))
, v1 AS (SELECT id, 'S:' || md5(take_aways) AS t FROM chosen)
, v2 AS (SELECT id, 'S:' || md5(t) AS t FROM v1)
, v3 AS (SELECT id, 'S:' || md5(t) AS t FROM v2)
, topics AS MATERIALIZED (SELECT CAST(id AS BIGINT) AS item_id, take_aways AS text FROM chosen)""" \
    + _embed_ctes("d", "documents", "doc_id", "text") + _embed_ctes("q", "topics", "item_id", "text") + """
, p AS (SELECT q.key AS item_id, d.key AS doc_id, round(list_inner_product(q.e, d.e), 6) AS distance FROM q, d)
, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance DESC, doc_id) AS rnk FROM p)
        WHERE rnk <= 3)
, refs AS (SELECT k.item_id, string_agg('- [' || substr(doc.text, 1, 30) || '](doc:' || CAST(k.doc_id AS VARCHAR) || ')',
                                        chr(10) ORDER BY k.rnk) AS refs
           FROM k JOIN documents doc ON k.doc_id = doc.doc_id GROUP BY k.item_id)
SELECT c.id, 'Body' || CASE WHEN coalesce(r.refs, '') <> '' THEN '|References' ELSE '' END AS sections,
       md5(v3.t) AS body_md5, r.refs
FROM chosen c JOIN v3 ON c.id = v3.id LEFT JOIN refs r ON CAST(c.id AS BIGINT) = r.item_id"""


@register("research_dive", uses=("rated_pages", "todo_state"), sql=_RESEARCH_SQL)
def research_dive(spark, sf):
    """Deep-dive pages never acted on -> evidence from documents -> three refinement rounds -> record sections."""
    pages = binding(spark, sf, "rated_pages").groupBy("id").agg(
        F.max_by("take_aways", "last_edited_time").alias("take_aways"), F.max_by("tags", "last_edited_time").alias("tags"))
    acted = binding(spark, sf, "todo_state").select(F.col("page_id").cast("string").alias("id"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = J.research(pages, acted, docs)
    sec = F.col("sections")
    return out["record"].select("id", F.array_join(F.transform(sec, lambda x: x["name"]), "|").alias("sections"),
                                F.md5(F.element_at(sec, 1)["text"]).alias("body_md5"),
                                F.try_element_at(sec, F.lit(2))["text"].alias("refs"))
