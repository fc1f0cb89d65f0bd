"""Raw-document normalisation queries.

Each query first shapes the test rows into the raw JSON document the
normaliser reads (``to_json``: input shaping only); the normaliser parses and
derives the fields.  The oracle derives the same fields from the flat columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import duck_ts_text, ts_text
from feedsift.sources import normalise as N

_TS = duck_ts_text
def _no_urls():
    return F.array().cast("array<struct<expanded_url:string>>")


def _urls(col):
    return F.when(col.isNotNull(), F.array(F.struct(col.alias("expanded_url")))).otherwise(_no_urls())


@register("normalise_short_posts", uses=("short_posts",), sql=f"""
SELECT list_id AS user_id, tweet_id, md5(CASE WHEN retweeted THEN rt_text ELSE text END) AS text_md5,
  CASE WHEN retweeted THEN coalesce(nullif(rt_url, ''), '') ELSE coalesce(nullif(media_url, ''), nullif(link_url, ''), '') END AS embed,
  'https://twitter.com/u' || CAST(list_id AS VARCHAR) || '/status/' || CAST(tweet_id AS VARCHAR) AS url, retweeted,
  {_TS("timezone('UTC', CAST(nullif(created_at, '') AS TIMESTAMPTZ))")} AS created_at_utc,
  {_TS("timezone('America/Los_Angeles', CAST(nullif(created_at, '') AS TIMESTAMPTZ))")} AS created_at_pdt,
  CASE WHEN reply_to IS NOT NULL THEN 'https://twitter.com/u' || CAST(list_id AS VARCHAR) || '/status/' || CAST(reply_to AS VARCHAR) END AS reply_url
FROM short_posts""")
def normalise_short_posts(spark, sf):
    """Raw short posts -> retweet override, embed (last media else last link), permalink, UTC/LA times."""
    p = binding(spark, sf, "short_posts")
    user = F.struct(F.col("name"), F.concat(F.lit("u"), F.col("list_id").cast("string")).alias("screen_name"),
                    F.col("list_id").alias("id"), F.lit("").alias("description"))
    rt = F.when(F.col("retweeted"), F.struct(F.col("rt_text").alias("full_text"),
                                             F.struct(_no_urls().alias("media"), _urls(F.col("rt_url")).alias("urls"))
                                             .alias("entities")))
    raw = F.to_json(F.struct(
        F.col("tweet_id").alias("id"), F.col("text").alias("full_text"), "created_at", user.alias("user"),
        F.struct(_urls(F.col("media_url")).alias("media"), _urls(F.col("link_url")).alias("urls")).alias("entities"),
        rt.alias("retweeted_status"), F.col("reply_to").alias("in_reply_to_status_id"),
        F.when(F.col("reply_to").isNotNull(), F.concat(F.lit("u"), F.col("list_id").cast("string")))
        .alias("in_reply_to_screen_name")))
    out = N.normalise_short_posts(p.select(raw.alias("raw")))
    return out.select("user_id", "tweet_id", F.md5("text").alias("text_md5"), "embed", "url", "retweeted",
                      ts_text("created_at_utc").alias("created_at_utc"), ts_text("created_at_pdt").alias("created_at_pdt"),
                      "reply_url")


_PF = ("CASE WHEN ts = floor(ts) THEN CAST(CAST(ts AS BIGINT) AS VARCHAR) || '.0' "
       "ELSE regexp_replace(printf('%.6f', ts), '0+$', '') END")
_AUTHOR = "coalesce(nullif(author, ''), nullif(author_fullname, ''), 'unknown_author')"
_URL = "replace(replace(CASE WHEN starts_with(url, '/r/') THEN 'https://www.reddit.com' || url ELSE url END, '&feature=share', ''), ' ', '')"


@register("normalise_posts", uses=("posts",), sql=f"""
, p AS (SELECT *, {_URL} AS u FROM posts)
SELECT md5(concat_ws('_', subreddit, title, {_AUTHOR}, {_PF})) AS id, {_AUTHOR} AS author,
  {_TS("timezone('UTC', to_timestamp(ts))")} AS datetime_utc,
  {_TS("timezone('America/Los_Angeles', to_timestamp(ts))")} AS datetime_pdt,
  u AS url, 'https://www.reddit.com' || permalink AS permalink,
  has_media OR contains(u, 'https://v.redd.it') AS is_video,
  suffix(u, 'jpg') OR suffix(u, 'png') OR suffix(u, 'gif') OR contains(u, 'https://i.redd.it') AS is_image,
  contains(u, 'www.reddit.com/gallery') AS is_gallery,
  NOT contains(u, 'https://www.reddit.com') AND NOT contains(u, '.redd.it') AS is_external_link,
  CASE WHEN has_media THEN 'reddit' ELSE 'unknown' END AS video_provider,
  CASE WHEN has_media THEN url || '/f' ELSE '' END AS video_url, ups, downs, num_comments
FROM p""")
def normalise_posts(spark, sf):
    """Raw posts -> hashed id, author fallback, UTC/LA times, url repair, permalink, media flags, video blob."""
    out = N.normalise_posts(raw_posts(binding(spark, sf, "posts")))
    return out.select("id", "author", ts_text("datetime_utc").alias("datetime_utc"),
                      ts_text("datetime_pdt").alias("datetime_pdt"), "url", "permalink", "is_video", "is_image",
                      "is_gallery", "is_external_link", F.col("video.video_provider").alias("video_provider"),
                      F.col("video.video_url").alias("video_url"), "ups", "downs", "num_comments")


def raw_posts(p):
    """The rows of ``posts`` as stored JSON."""
    media = F.when(F.col("has_media"), F.struct(
        F.struct(F.concat("url", F.lit("/f")).alias("fallback_url"), F.lit("").alias("dash_url")).alias("reddit_video"),
        F.lit(None).cast("string").alias("type"),
        F.struct(F.lit(None).cast("string").alias("provider_name")).alias("oembed")))
    data = F.struct(F.col("ts").alias("created_utc"), "author", "author_fullname", "subreddit", "title", "url",
                    "permalink", F.col("text").alias("selftext"), "ups", "downs", "num_comments",
                    F.lit(False).alias("is_video"), F.lit(None).cast("boolean").alias("is_gallery"), media.alias("media"))
    return p.select(F.to_json(F.struct(data.alias("data"))).alias("raw"))


@register("page_properties", uses=(), sql="""
SELECT conv_id, turn, role || ' #' || CAST(turn AS VARCHAR) AS title,
  CASE turn % 3 WHEN 0 THEN 'RSS' WHEN 1 THEN 'Reddit' ELSE 'Twitter' END AS source,
  role || '|t' || CAST(turn % 4 AS VARCHAR) AS tags, substr(text, 1, 30) AS notes,
  '2024-02-' || lpad(CAST(1 + turn % 28 AS VARCHAR), 2, '0') AS date
FROM conversations""")
def page_properties(spark, sf):
    """Title, select, multi-select, rich text and date start from a page's property blob."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    rich = lambda *xs: F.array(*[F.struct(x.alias("plain_text")) for x in xs])
    props = F.to_json(F.struct(
        F.struct(rich(F.col("role"), F.concat(F.lit(" #"), F.col("turn").cast("string"))).alias("title")).alias("Name"),
        F.struct(F.struct(F.element_at(F.array(F.lit("RSS"), F.lit("Reddit"), F.lit("Twitter")),
                                       (F.col("turn") % 3 + 1).cast("int")).alias("name")).alias("select")).alias("Source"),
        F.struct(F.array(F.struct(F.col("role").alias("name")),
                         F.struct(F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")).alias("name")))
                 .alias("multi_select")).alias("Tags"),
        F.struct(rich(F.substring("text", 1, 30)).alias("rich_text")).alias("Notes"),
        F.struct(F.struct(F.concat(F.lit("2024-02-"), F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"))
                          .alias("start")).alias("date")).alias("Date")))
    p = N.page_properties(props)
    return c.select("conv_id", "turn", p["title"].alias("title"), p["source"].alias("source"),
                    F.array_join(p["tags"], "|").alias("tags"), p["notes"].alias("notes"), p["date"].alias("date"))
