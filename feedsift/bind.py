"""Fixture bindings: the given test tables -> the inputs each operator expects.

A binding only renames and projects columns of the test tables into an
operator's input schema; it does none of the operator's work.  Every binding is
one SQL text that both Spark (``spark.sql`` with DataFrame parameters, no temp
views) and DuckDB (plain table names) accept, so the oracle sees exactly the
rows the Spark query sees.  Literal braces are doubled (``{{``) because table
references are written as ``{table}``.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

BINDINGS: dict[str, str] = {
    # ---- items, visited set, ratings, scores (FIXTURES §3)
    "items": "SELECT doc_id AS id, source AS list_name, lang, substr(text, 1, 40) AS title, text AS body, n_chars "
             "FROM {documents}",
    "visited": "SELECT doc_id AS item_id, source AS list_name FROM {documents} WHERE doc_id % 4 = 0",
    "ratings": "SELECT doc_id AS page_id, CAST(1 + 2 * quality + 2 * (1 - toxic) AS INT) AS user_rating FROM {labels}",
    "scored": "SELECT doc_id AS id, source AS list_name, CAST(CASE WHEN doc_id % 11 = 0 THEN -1 "
              "ELSE (doc_id % 11) / 2.0 END AS DOUBLE) AS relevant_score FROM {documents}",
    # ---- vectors: the embeddings table split into new items (queries) and rated items
    "vec_queries": "SELECT vec_id AS query_id, embedding FROM {embeddings} WHERE vec_id % 10 = 0",
    "vec_rated": "SELECT vec_id AS item_id, embedding, CAST(label % 2 AS INT) AS as_of_offset "
                 "FROM {embeddings} WHERE vec_id % 10 <> 0",
    "rated_meta": "SELECT vec_id AS item_id, CAST(label % 5 + 1 AS INT) AS user_rating FROM {embeddings} "
                  "WHERE vec_id % 7 <> 3",
    # ---- versioned pages, watermarks
    "versions": "SELECT user_id AS page_id, event_id AS arrival, ts AS last_edited, CAST(ts AS DATE) AS day, "
                "event_type AS source, CASE WHEN event_type = 'error' THEN NULL "
                "ELSE CAST(floor(value) AS INT) % 5 + 1 END AS user_rating FROM {events}",
    "todo_state": "SELECT user_id AS page_id, CASE WHEN user_id % 3 = 0 THEN max(ts) ELSE min(ts) END AS last_edited "
                  "FROM {events} WHERE user_id % 3 <> 2 GROUP BY user_id",
    "watermarks": "SELECT event_type AS source, min(ts) AS ts FROM {events} WHERE event_type <> 'signup' "
                  "GROUP BY event_type",
    # ---- feeds, partitions, subscriptions, index
    "feed_entries": "SELECT source AS feed, doc_id AS pos, substr(text, 1, 40) AS title, "
                    "CASE WHEN doc_id % 4 = 3 THEN lang ELSE 'Thu, ' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || ' Mar 2022 ' "
                    "|| lpad(CAST(doc_id % 24 AS STRING), 2, '0') || ':30:00 ' "
                    "|| CASE WHEN doc_id % 4 = 0 THEN 'GMT' WHEN doc_id % 4 = 1 THEN '-0500' ELSE '+0900' END END AS raw_date "
                    "FROM {documents}",
    "partitions": "SELECT CAST(year(o_orderdate) AS INT) AS partition_id, min(o_orderdate) AS created_time, "
                  "count(*) AS n FROM {orders} GROUP BY year(o_orderdate)",
    "subscriptions": "SELECT c_custkey AS member, c_acctbal > 0 AS enabled, "
                     "split(c_mktsegment || ',' || n_name, ',') AS list_names "
                     "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey",
    "index_pages": "SELECT r_name AS category, n_name AS name, CAST(n_nationkey AS STRING) AS index_id "
                   "FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    # ---- blocks, replies
    "blocks": "SELECT conv_id AS page_id, turn AS pos, CASE WHEN turn % 4 = 0 THEN 'paragraph' "
              "WHEN turn % 4 = 1 THEN 'bulleted_list_item' WHEN turn % 4 = 2 THEN 'numbered_list_item' "
              "ELSE 'code' END AS type, text FROM {conversations}",
    # block trees of 20 blocks a page: block j hangs under (j - 1) / 2, five levels deep; block 3 is a table, block 5 reads no children
    "tree_blocks": "SELECT CAST(floor(doc_id / 20) AS BIGINT) AS page_id, doc_id AS block_id, "
                   "CASE WHEN doc_id % 20 > 0 THEN doc_id - doc_id % 20 + CAST(floor((doc_id % 20 - 1) / 2) AS BIGINT) END AS parent, "
                   "100 - doc_id % 20 AS pos, CASE WHEN doc_id % 20 = 3 THEN 'table' WHEN doc_id % 20 IN (7, 8) THEN 'table_row' "
                   "WHEN doc_id % 20 = 5 THEN 'quote' WHEN doc_id % 20 < 10 THEN 'toggle' WHEN doc_id % 3 = 0 THEN 'bulleted_list_item' "
                   "WHEN doc_id % 3 = 1 THEN 'code' ELSE 'paragraph' END AS type, text, split(lang || ';' || source || ';x', ';') AS cells "
                   "FROM {documents}",
    # stored papers with their publication time
    "papers": "SELECT doc_id, text, TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE AS published FROM {documents}",
    "replies": "SELECT conv_id, turn, role AS name, text, CASE WHEN turn > 0 THEN turn - 1 END AS reply_to_turn, "
               "(conv_id + turn) % 5 = 0 AS target_deleted FROM {conversations}",
    # ---- model answers, cache, action lines, summaries, media urls
    "rank_json": "SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '{{\"topics\": [' "
                 "ELSE '{{\"feedback\": \"f' || CAST(doc_id % 3 AS STRING) || '\", \"topics\": [{{\"topic\": \"' "
                 "|| lang || '\", \"category\": \"' || source || '\", \"score\": ' || CAST(doc_id % 2 AS STRING) "
                 "|| '}}], \"overall_score\": ' || CAST(doc_id % 2 AS STRING) || '}}' END AS answer FROM {documents}",
    # texts with the labels that the rank classifier learns (M4)
    "rank_training": "SELECT d.doc_id, d.text, d.lang AS topic, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS category, "
                     "CAST(l.quality AS STRING) AS quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id",
    "cache": "SELECT doc_id AS item_id, 'S:' || md5(text) AS value, doc_id % 6 = 0 AS expired "
             "FROM {documents} WHERE doc_id % 3 = 0",
    "action_lists": "SELECT doc_id AS id, 'Action Items' || chr(10) || '1. ' || lang || chr(10) || chr(10) "
                    "|| '2. None' || chr(10) || '3. ' || source AS todo, 'T' || chr(10) || '1. t' || lang "
                    "|| chr(10) || chr(10) || '2. None' AS todo_trans FROM {documents}",
    "summaries": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang || ' a ' || chr(10) || chr(10) || ' b' "
                 "ELSE ' ' || lang || ' === ' || source || ' === x ' END AS summary FROM {documents}",
    "media_urls": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url || '/a.png' "
                  "WHEN page_id % 5 = 1 THEN 'https://v.redd.it/' || CAST(page_id AS STRING) "
                  "WHEN page_id % 5 = 2 THEN 'https://www.reddit.com/gallery/' || CAST(page_id AS STRING) "
                  "WHEN page_id % 5 = 3 THEN '/r/x/' || CAST(page_id AS STRING) "
                  "ELSE 'https://arxiv.org/pdf/1706.' || CAST(10000 + page_id AS STRING) || 'v2.pdf' END AS url, "
                  "page_id % 9 = 0 AS has_media FROM {pages}",
    # ---- extra bindings (same rule: projection of the test tables into an operator's input schema)
    # rated pages of the sync / digest / takeaway scans: one version per event
    "rated_pages": "SELECT CAST(user_id AS STRING) AS id, event_type AS source, ts AS created_time, "
                   "ts + INTERVAL 1 HOUR AS last_edited_time, "
                   "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(floor(value) AS INT) % 5 + 1 AS STRING) "
                   "END AS user_rating, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'take ' || props END AS take_aways, "
                   "event_id AS arrival, value AS relevant, "
                   "split(CASE WHEN event_id % 6 = 0 THEN 'action:deepdive,misc' ELSE 'misc' END, ',') AS tags "
                   "FROM {events}",
    # journal notes and inbox pages
    "notes": "SELECT doc_id AS id, source, substr(text, 1, 30) AS title, "
             "TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE AS created_time, "
             "TIMESTAMP '2024-01-01 00:30:00' + CAST(doc_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE AS last_edited_time, "
             "text AS content FROM {documents}",
    # raw short posts stored as JSON (S9); quoted/reply fields derived from the conversation turns
    "short_posts": "SELECT conv_id AS list_id, turn AS tweet_id, role AS name, text, "
                   "CASE WHEN turn % 3 = 0 THEN 'https://t.co/m' || CAST(turn AS STRING) END AS media_url, "
                   "CASE WHEN turn % 2 = 0 THEN 'https://x.test/u' || CAST(turn AS STRING) END AS link_url, "
                   "turn % 4 = 1 AS retweeted, CASE WHEN turn % 4 = 1 THEN 'RT ' || role END AS rt_text, "
                   "CASE WHEN turn % 4 = 1 THEN 'https://t.co/rt' || CAST(turn AS STRING) END AS rt_url, "
                   "CASE WHEN turn % 3 = 2 THEN '' ELSE '2024-03-' || lpad(CAST(1 + conv_id % 28 AS STRING), 2, '0') "
                   "|| 'T' || lpad(CAST(turn % 24 AS STRING), 2, '0') || ':15:00' "
                   "|| CASE WHEN turn % 3 = 0 THEN '.000Z' ELSE '+00:00' END END AS created_at, "
                   "CASE WHEN turn > 0 THEN turn - 1 END AS reply_to "
                   "FROM {conversations}",
    # short posts of two kinds of lists, each answering the turn before, and those read already
    "list_posts": "SELECT CASE WHEN conv_id % 3 = 0 THEN 'tech' ELSE 'news' END AS list_name, conv_id * 1000 + turn AS id, role AS name, text, "
                  "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS reply_to FROM {conversations}",
    "posts_read": "SELECT CASE WHEN conv_id % 3 = 0 THEN 'tech' ELSE 'news' END AS list_name, conv_id * 1000 + turn AS item_id FROM {conversations} WHERE turn % 4 = 3",
    # videos, their transcript tracks by language, cached transcripts (S21, C3): a conversation is a video, its turns the parts
    "videos": "SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'video0' ELSE 'video1' END AS source, substr(min(text), 1, 30) AS title, "
              "CASE WHEN conv_id % 7 = 0 THEN 'https://www.twitch.tv/v' ELSE 'https://video.test/v' END || CAST(conv_id AS STRING) AS url, "
              "TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE AS created_time FROM {conversations} GROUP BY conv_id",
    "video_watermarks": "SELECT CASE WHEN conv_id % 3 = 0 THEN 'video0' ELSE 'video1' END AS source, "
                        "min(TIMESTAMP '2024-01-01 00:00:00' + CAST(conv_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE) + INTERVAL 1 HOUR AS ts FROM {conversations} GROUP BY 1",
    "videos_seen": "SELECT DISTINCT conv_id AS item_id FROM {conversations} WHERE conv_id % 4 = 1",
    "video_tracks": "SELECT conv_id AS video_id, CASE role WHEN 'system' THEN 'en' WHEN 'assistant' THEN 'fr' ELSE 'de' END AS lang, turn AS part, text FROM {conversations}",
    "transcript_cache": "SELECT conv_id AS item_id, CASE WHEN conv_id % 10 = 0 THEN '' ELSE text END AS value, CASE WHEN conv_id % 15 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' "
                        "ELSE TIMESTAMP '2024-12-31 00:00:00' END AS expires_at FROM {conversations} WHERE conv_id % 5 = 0 AND turn = 1",
    # forum posts
    "posts": "SELECT CAST(conv_id * 1000 + turn AS STRING) AS id, role AS subreddit, substr(text, 1, 40) AS title, "
             "CASE WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'a' || CAST(conv_id AS STRING) END AS author, "
             "CASE WHEN turn % 2 = 0 THEN 'u_' || CAST(conv_id AS STRING) END AS author_fullname, "
             "CAST(1700000000 + conv_id * 100 + turn AS DOUBLE) + CASE WHEN turn % 5 = 0 THEN 0.5 ELSE 0 END AS ts, "
             "text, CASE WHEN turn % 4 = 0 THEN '/r/' || role || '/c' || CAST(conv_id AS STRING) "
             "WHEN turn % 4 = 1 THEN 'https://v.redd.it/v' || CAST(turn AS STRING) "
             "WHEN turn % 4 = 2 THEN 'https://i.redd.it/p' || CAST(turn AS STRING) || '.png' "
             "ELSE 'https://arxiv.org/abs/2101.' || CAST(10000 + conv_id AS STRING) END AS url, "
             "'/r/' || role || '/comments/' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS permalink, "
             "turn % 5 = 0 AS has_media, CAST(length(text) AS BIGINT) AS ups, turn AS downs, conv_id % 7 AS num_comments "
             "FROM {conversations}",
    # summary caches holding half / all of the documents (read-through hit-rate variants of J9)
    "cache_half": "SELECT doc_id AS item_id, 'S:' || md5(text) AS value FROM {documents} WHERE doc_id % 2 = 0",
    "cache_all": "SELECT doc_id AS item_id, 'S:' || md5(text) AS value FROM {documents}",
    # stored page metadata (J4, K11): rating before the latest change, some pages without metadata
    "page_state": "SELECT doc_id AS page_id, CAST(1 + 2 * quality AS INT) AS user_rating FROM {labels} "
                  "WHERE doc_id % 5 <> 0",
    # per-source watermarks of the inbox notes
    "note_watermarks": "SELECT source, min(TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id * 37 % 43200 AS INT) * INTERVAL 1 MINUTE) "
                       "+ INTERVAL 10 DAY AS ts FROM {documents} WHERE source <> 'src3' GROUP BY source",
    # customers with an index category (region, or a category the index does not hold) and name
    "customer_regions": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE r_name END AS category, "
                        "n_name AS name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey "
                        "JOIN {region} ON n_regionkey = r_regionkey",
    # dated vector collection
    "vectors": "SELECT 'hashing' AS model, CAST(DATE '2024-01-10' - CAST(label % 4 AS INT) AS DATE) AS as_of, "
               "CAST(vec_id AS STRING) AS item_id, embedding FROM {embeddings}",
}


def _tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql.replace("{{", "").replace("}}", ""))))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given test tables."""
    return _read(spark, sf_dir, name)


def binding(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build binding ``name`` on the Spark side over ``sf_dir``."""
    sql = BINDINGS[name]
    args = {t: _read(spark, sf_dir, t) for t in _tables_of(sql)}
    return spark.sql(sql, **args)


@lru_cache(maxsize=None)
def duck_text(name: str) -> str:
    """The binding as DuckDB text (plain table names)."""
    sql = BINDINGS[name]
    return sql.format(**{t: t for t in _tables_of(sql)})


def with_bindings(names: list[str] | tuple[str, ...], body: str, recursive: bool = False) -> str:
    """``WITH [RECURSIVE] b1 AS (...), b2 AS (...) body`` for the DuckDB oracle."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    if not names:
        b = body.lstrip()
        return head + b[1:] if b.startswith(",") else body
    ctes = ",\n".join(f"{n} AS ({duck_text(n)})" for n in names)
    return f"{head}{ctes}\n{body}"
