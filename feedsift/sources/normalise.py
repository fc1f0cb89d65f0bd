"""Raw-document normalisers (S9, S10, S13): stored JSON -> the common flat schemas.

Each source keeps its raw API document in one string column; a fixed schema
parses it once (``from_json``) and built-in expressions derive the fields, so
the whole normalisation stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsift.functions import media as M
from feedsift.functions.text import LOCAL_TZ, author_fallback, parse_iso, post_id, py_float_str, url_repair

# Hosts used to build permalinks.
SHORT_POST_HOST = "https://twitter.com"
POST_HOST = "https://www.reddit.com"

_URLS = T.ArrayType(T.StructType([T.StructField("expanded_url", T.StringType())]))
_ENTITIES = T.StructType([T.StructField("media", _URLS), T.StructField("urls", _URLS)])
SHORT_POST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("user", T.StructType([T.StructField("name", T.StringType()), T.StructField("screen_name", T.StringType()),
                                        T.StructField("id", T.LongType()), T.StructField("description", T.StringType())])),
    T.StructField("entities", _ENTITIES),
    T.StructField("retweeted_status", T.StructType([T.StructField("full_text", T.StringType()),
                                                    T.StructField("entities", _ENTITIES)])),
    T.StructField("in_reply_to_status_id", T.LongType()),
    T.StructField("in_reply_to_screen_name", T.StringType()),
])

POST_SCHEMA = T.StructType([T.StructField("data", T.StructType([
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("author", T.StringType()),
    T.StructField("author_fullname", T.StringType()),
    T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("permalink", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("ups", T.LongType()),
    T.StructField("downs", T.LongType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("is_video", T.BooleanType()),
    T.StructField("is_gallery", T.BooleanType()),
    T.StructField("media", T.StructType([
        T.StructField("reddit_video", T.StructType([T.StructField("fallback_url", T.StringType()),
                                                    T.StructField("dash_url", T.StringType())])),
        T.StructField("type", T.StringType()),
        T.StructField("oembed", T.StructType([T.StructField("provider_name", T.StringType())]))])),
    T.StructField("media_metadata", T.MapType(T.StringType(), T.StructType([
        T.StructField("status", T.StringType()), T.StructField("e", T.StringType()),
        T.StructField("s", T.StructType([T.StructField("u", T.StringType()), T.StructField("gif", T.StringType())]))]))),
]))])

_RICH = T.ArrayType(T.StructType([T.StructField("plain_text", T.StringType())]))
_NAMED = T.StructType([T.StructField("name", T.StringType())])
PROPERTY_SCHEMA = T.StructType([
    T.StructField("Name", T.StructType([T.StructField("title", _RICH)])),
    T.StructField("Source", T.StructType([T.StructField("select", _NAMED)])),
    T.StructField("Tags", T.StructType([T.StructField("multi_select", T.ArrayType(_NAMED))])),
    T.StructField("Notes", T.StructType([T.StructField("rich_text", _RICH)])),
    T.StructField("Date", T.StructType([T.StructField("date", T.StructType([T.StructField("start", T.StringType())]))])),
])


def utc_wall_time(instant: Column) -> Column:
    """TIMESTAMP instant -> its UTC wall-clock time (TIMESTAMP_NTZ), whatever the session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def _last_url(urls: Column) -> Column:
    return F.nullif(F.try_element_at(urls, F.lit(-1))["expanded_url"], F.lit(""))


def _embed(entities: Column) -> Column:
    """Last media url, else last link url, else ''."""
    return F.coalesce(_last_url(entities["media"]), _last_url(entities["urls"]), F.lit(""))


def normalise_short_posts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Retweets override text and embed; embed = last media url else last url; permalink; UTC and LA times."""
    j = F.from_json(F.col(raw), SHORT_POST_SCHEMA)
    d = df.withColumn("_j", j)
    rt = F.col("_j.retweeted_status")
    utc = utc_wall_time(parse_iso(F.col("_j.created_at")))
    return d.select(
        F.col("_j.id").alias("tweet_id"),
        F.col("_j.user.name").alias("name"),
        F.col("_j.user.screen_name").alias("screen_name"),
        F.col("_j.user.id").alias("user_id"),
        utc.alias("created_at_utc"),
        F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), utc).alias("created_at_pdt"),
        F.when(rt.isNotNull(), rt["full_text"]).otherwise(F.col("_j.full_text")).alias("text"),
        F.when(rt.isNotNull(), _embed(rt["entities"])).otherwise(_embed(F.col("_j.entities"))).alias("embed"),
        F.concat(F.lit(SHORT_POST_HOST + "/"), F.col("_j.user.screen_name"), F.lit("/status/"),
                 F.col("_j.id").cast("string")).alias("url"),
        rt.isNotNull().alias("retweeted"),
        F.col("_j.in_reply_to_status_id").alias("reply_to_status_id"),
        F.when(F.col("_j.in_reply_to_status_id").isNotNull(),
               F.concat(F.lit(SHORT_POST_HOST + "/"), F.col("_j.in_reply_to_screen_name"), F.lit("/status/"),
                        F.col("_j.in_reply_to_status_id").cast("string"))).alias("reply_url"),
    )


def normalise_posts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Author fallback, hashed id, UTC/LA times, relative-url repair, permalink, media flags, video blob, gallery.

    Timestamps are read as UTC (trap Q19 fixed).  Remote text loading (web
    pages, transcripts) is not part of the normaliser.
    """
    d = df.withColumn("_d", F.from_json(F.col(raw), POST_SCHEMA)["data"])
    c = lambda n: F.col(f"_d.{n}")
    url = url_repair(c("url"))
    utc = utc_wall_time(F.timestamp_micros((c("created_utc") * 1_000_000).cast("long")))
    author = author_fallback(c("author"), c("author_fullname"))
    long_id = F.concat_ws("_", c("subreddit"), c("title"), author, py_float_str(c("created_utc")))
    return d.select(
        post_id(c("subreddit"), c("title"), c("author"), c("author_fullname"), c("created_utc")).alias("id"),
        long_id.alias("long_id"),
        c("created_utc").alias("timestamp"),
        utc.alias("datetime_utc"),
        F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), utc).alias("datetime_pdt"),
        F.lit("Reddit").alias("source"),
        c("title").alias("title"), c("selftext").alias("text"),
        url.alias("url"),
        F.concat(F.lit(POST_HOST), c("permalink")).alias("permalink"),
        c("subreddit").alias("subreddit"), author.alias("author"),
        c("ups").alias("ups"), c("downs").alias("downs"), c("num_comments").alias("num_comments"),
        M.is_video(c("media").isNotNull(), c("is_video"), url).alias("is_video"),
        M.is_image(url).alias("is_image"),
        M.is_gallery(c("is_gallery"), url).alias("is_gallery"),
        M.is_external_link(url).alias("is_external_link"),
        M.video_blob(c("media"), c("url")).alias("video"),
        F.coalesce(M.gallery_media(c("media_metadata")),
                   F.array().cast("array<struct<id:string,type:string,url:string>>")).alias("gallery_medias"),
    )


def _plain(rich: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(rich, F.array().cast(_RICH)), lambda x: x["plain_text"]), "")


def page_properties(props: Column) -> Column:
    """struct(title, source, tags, notes, date) from a document-store property blob (JSON text)."""
    p = F.from_json(props, PROPERTY_SCHEMA)
    return F.struct(
        _plain(p["Name"]["title"]).alias("title"),
        p["Source"]["select"]["name"].alias("source"),
        F.transform(F.coalesce(p["Tags"]["multi_select"], F.array().cast(T.ArrayType(_NAMED))),
                    lambda x: x["name"]).alias("tags"),
        _plain(p["Notes"]["rich_text"]).alias("notes"),
        p["Date"]["date"]["start"].alias("date"),
    )
