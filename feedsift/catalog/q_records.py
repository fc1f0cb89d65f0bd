"""Sink / record queries and remaining scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import RUN_DATE, RUN_TS, duck_ts_text, ts, ts_text
from feedsift.functions import media as M
from feedsift.operators import filters as FL
from feedsift.operators.dedup import anti_join_visited
from feedsift.operators.embed import hashing_embedding
from feedsift.session import ensure_checkpoint_dir
from feedsift.sinks import collections as CO
from feedsift.sinks import documents as DOC
from feedsift.sources.scans import read_snapshot, sync_rated

_TS = duck_ts_text


@register("roundtrip_snapshot", uses=("items",), sql="SELECT id, list_name, title, body FROM items")
def roundtrip_snapshot(spark, sf):
    """A batch written as JSON files of a run and read back with its fixed schema is unchanged."""
    i = binding(spark, sf, "items").select("id", "list_name", "title", "body")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    DOC.write_snapshot(i, folder, RUN_DATE)
    return read_snapshot(spark, f"{folder}/run_id={RUN_DATE}", i.schema)


@register("vector_append", uses=("items", "visited"), sql=f"""
SELECT CAST(i.id AS VARCHAR) AS item_id, DATE '{RUN_DATE}' AS as_of, 'hashing' AS model, 64 AS dims
FROM items i WHERE i.id NOT IN (SELECT item_id FROM visited)""")
def vector_append(spark, sf):
    """K2: rows to append to the run date's collection: not yet indexed items, embedded."""
    items = binding(spark, sf, "items")
    visited = binding(spark, sf, "visited").select("item_id")
    rows = DOC.vector_rows(anti_join_visited(items, visited, {"id": "item_id"}), "id", hashing_embedding(F.col("body")),
                           model="hashing", as_of=RUN_DATE)
    return rows.select("item_id", "as_of", "model", F.size("embedding").alias("dims"))


@register("published_rows", uses=("scored", "items"), sql="""
SELECT s.id, i.title AS name, 'documents' AS source, s.list_name,
       CASE WHEN s.relevant_score IS NOT NULL AND s.relevant_score <> 0 THEN s.relevant_score END AS relevant_score,
       array_to_string(string_split(i.title, ' ')[1:3], '|') AS tags
FROM scored s JOIN items i ON s.id = i.id""")
def published_rows(spark, sf):
    """K4: the published record properties; the relevant score only when truthy (trap Q4)."""
    s = binding(spark, sf, "scored").join(binding(spark, sf, "items").select("id", "title"), "id")
    out = DOC.published_rows(s, name=F.col("title"), source=F.lit("documents"), tags=F.split("title", " "))
    return out.select("id", "name", "source", "list_name", "relevant_score", F.array_join("tags", "|").alias("tags"))


@register("post_blocks", uses=("media_urls",), sql="""
, f AS (SELECT page_id, has_media OR contains(url, 'https://v.redd.it') AS v,
               suffix(url, 'jpg') OR suffix(url, 'png') OR suffix(url, 'gif') OR contains(url, 'https://i.redd.it') AS i,
               contains(url, 'www.reddit.com/gallery') AS g,
               NOT contains(url, 'https://www.reddit.com') AND NOT contains(url, '.redd.it') AS e FROM media_urls)
SELECT page_id, CASE WHEN v THEN 'video|' WHEN i THEN 'image|' WHEN g THEN 'gallery|' WHEN e THEN 'bookmark|' ELSE '' END
                || 'quote|summary|permalink|metadata' AS blocks FROM f""")
def post_blocks(spark, sf):
    """K5: post body blocks: one media block by precedence video, image, gallery, external; then text blocks."""
    m = binding(spark, sf, "media_urls")
    flags = m.select("page_id", M.is_video("has_media", F.lit(False), "url").alias("v"), M.is_image("url").alias("i"),
                     M.is_gallery(F.lit(None).cast("boolean"), "url").alias("g"), M.is_external_link("url").alias("e"))
    return flags.select("page_id", F.array_join(DOC.post_block_kinds("v", "i", "g", "e"), "|").alias("blocks"))


_LATEST_RATED = """
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '') WHERE rn = 1)"""
_DIGEST = _LATEST_RATED + """
, digest AS (SELECT * FROM latest WHERE CAST(user_rating AS INTEGER) * 0.8 + relevant / 10.0 * 0.2 >= 4.5
             ORDER BY relevant DESC, id LIMIT 10)"""


def _digest(spark, sf):
    p = sync_rated(binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time",
                                                           "relevant", "take_aways", "tags"))
    p = p.withColumn("relevant_score", F.col("relevant") / 10.0).withColumn("user_rating", F.col("user_rating").cast("int"))
    return FL.digest_postfilter(p)


@register("digest_sections", uses=("rated_pages",), sql=_DIGEST + """
SELECT source, CAST(count(*) AS BIGINT) AS n_pages,
       '## ' || source || chr(10) || string_agg('- ' || id, chr(10) ORDER BY relevant DESC, id) AS section
FROM digest GROUP BY source""")
def digest_sections(spark, sf):
    """The digest's pages grouped by source, one heading and ordered links per source."""
    return DOC.digest_sections(_digest(spark, sf))


@register("digest_labels", uses=("rated_pages",), sql=_DIGEST + """
SELECT array_to_string(list_sort(list_distinct(flatten(list(list_concat(tags, [source]))))), '|') AS labels FROM digest""")
def digest_labels(spark, sf):
    """Sorted distinct union of the digest pages' labels."""
    d = _digest(spark, sf).select(F.concat("tags", F.array("source")).alias("labels"))
    return DOC.distinct_labels(d, "labels").select(F.array_join("labels", "|").alias("labels"))


@register("markdown_render", uses=("rated_pages",), sql=_LATEST_RATED + """
, r AS (SELECT source || '_default_' || id || '.md' AS file_name,
               '---' || chr(10) || 'title: ' || id || chr(10) || 'source: ' || source || chr(10) || 'rating: ' || user_rating
               || chr(10) || '---' || chr(10) || coalesce(take_aways, '') || chr(10) AS content, id
        FROM latest WHERE CAST(user_rating AS INTEGER) >= 4)
SELECT file_name, md5(content) AS content_md5 FROM r WHERE CAST(id AS BIGINT) % 5 <> 0""")
def markdown_render(spark, sf):
    """Markdown files for rating >= 4 pages, skipping names that already exist."""
    p = sync_rated(binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time",
                                                           "take_aways"))
    p = p.where(F.col("user_rating").cast("int") >= 4)
    files = DOC.markdown_files(p)
    existing = files.where(F.col("id").cast("bigint") % 5 == 0).select("file_name")
    out = files.join(existing, "file_name", "left_anti")
    return out.select("file_name", F.md5("content").alias("content_md5"))


@register("markdown_files", uses=("rated_pages",), sql=_LATEST_RATED + """
, r AS (SELECT id, source || '_default_' || id || '.md' AS file_name, '---' || chr(10) || 'title: ' || id || chr(10) || 'source: ' || source || chr(10)
               || 'rating: ' || user_rating || chr(10) || '---' || chr(10) || coalesce(take_aways, '') || chr(10) AS content
        FROM latest WHERE CAST(user_rating AS INTEGER) >= 4)
SELECT file_name, md5(CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'older' ELSE content END) AS content_md5 FROM r""")
def markdown_files(spark, sf):
    """The archive written as named files beside older ones, which keep their content, and read back."""
    p = sync_rated(binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time", "take_aways"))
    files = DOC.markdown_files(p.where(F.col("user_rating").cast("int") >= 4))
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/markdown-{uuid.uuid4().hex}"
    DOC.write_markdown(files.where(F.col("id").cast("bigint") % 5 == 0).withColumn("content", F.lit("older")), folder)
    DOC.write_markdown(files, folder)
    return spark.read.text(f"{folder}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"[^/]+$", 0).alias("file_name"), F.md5("value").alias("content_md5"))


@register("collection_retention", uses=("vectors",), sql="""
SELECT model, as_of, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT item_id) AS BIGINT) AS n_items,
       round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total
FROM vectors WHERE as_of > DATE '2024-01-11' - 3 GROUP BY model, as_of""")
def collection_retention(spark, sf):
    """Collections appended to a dated table, one batch twice, and the old ones dropped by folder; what is left, by vector values."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/collections-{uuid.uuid4().hex}"
    rows = binding(spark, sf, "vectors")
    for batch, part in (("even", rows.where(F.col("item_id").cast("bigint") % 2 == 0)), ("odd", rows.where(F.col("item_id").cast("bigint") % 2 == 1)), ("odd", rows.where(F.col("item_id").cast("bigint") % 2 == 1))):
        CO.append_batch(part, path, batch)
    CO.drop_collections(spark, path, "2024-01-11", 3)
    left = CO.read_collections(spark, path).where(F.col("as_of") > F.date_sub(F.to_date(F.lit("2024-01-11")), 3))
    value = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return left.groupBy("model", "as_of").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("item_id").alias("n_items"), F.round(F.sum(value), 4).alias("total"))


@register("retention_keep", uses=("vectors",), sql="""
SELECT as_of, CAST(count(*) AS BIGINT) AS n_rows FROM vectors WHERE as_of > DATE '2024-01-11' - 3 GROUP BY as_of""")
def retention_keep(spark, sf):
    """Collections dated on or before run date - 3 are dropped; the rest are kept."""
    kept = DOC.retention_keep(binding(spark, sf, "vectors"), "2024-01-11", 3)
    return kept.groupBy("as_of").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@register("research_record", uses=("notes",), sql="""
, s AS (SELECT id, content AS body, CASE WHEN id % 2 = 0 THEN title ELSE '' END AS refs,
               CASE WHEN id % 3 = 0 THEN source ELSE '' END AS appendix FROM notes)
SELECT id, 'Body' || CASE WHEN refs <> '' THEN '|References' ELSE '' END || CASE WHEN appendix <> '' THEN '|Appendix' ELSE '' END AS sections
FROM s""")
def research_record(spark, sf):
    """Body, then References and Appendix sections only when non-empty."""
    n = binding(spark, sf, "notes")
    s = n.select("id", F.col("content").alias("body"),
                 F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.lit("")).alias("refs"),
                 F.when(F.col("id") % 3 == 0, F.col("source")).otherwise(F.lit("")).alias("appendix"))
    rec = DOC.research_sections(s)
    return rec.select("id", F.array_join(F.transform("sections", lambda x: x["name"]), "|").alias("sections"))


@register("metadata_insert", uses=("customer_regions", "index_pages"), sql="""
SELECT DISTINCT category, name FROM customer_regions c
WHERE NOT EXISTS (SELECT 1 FROM index_pages i WHERE i.category = c.category AND i.name = c.name)""")
def metadata_insert(spark, sf):
    """New (category, name) keys to insert; an insert hitting an existing key fails the job."""
    new = binding(spark, sf, "customer_regions").select("category", "name").distinct()
    existing = binding(spark, sf, "index_pages")
    fresh = anti_join_visited(new, existing, {"category": "category", "name": "name"})
    return DOC.checked_insert(existing.select("category", "name"), fresh, ["category", "name"])


@register("pending_versions", uses=("partitions",), sql="""
SELECT partition_id FROM partitions WHERE partition_id % 2 <> 0 ORDER BY partition_id""")
def pending_versions(spark, sf):
    """Registry of ordered version ids minus the applied ones (here the even ids), in order."""
    reg = binding(spark, sf, "partitions").select("partition_id")
    applied = reg.where(F.col("partition_id") % 2 == 0)
    return anti_join_visited(reg, applied, {"partition_id": "partition_id"}).orderBy("partition_id")


@register("preferred_language", uses=("items",), sql="""
, r AS (SELECT list_name, id, lang, row_number() OVER (PARTITION BY list_name
          ORDER BY list_position(['en', 'de', 'fr', 'es'], lang), id) AS rn FROM items
        WHERE list_position(['en', 'de', 'fr', 'es'], lang) IS NOT NULL AND NOT contains(list_name, 'twitch.tv'))
SELECT list_name, id, lang FROM r WHERE rn = 1""")
def preferred_language(spark, sf):
    """Per video (here per list) the transcript in the first preferred language (ties by id)."""
    i = binding(spark, sf, "items").select("list_name", "id", "lang")
    return DOC.preferred_transcript(i, "list_name", "id", "lang", ["en", "de", "fr", "es"], url=F.col("list_name"))


@register("video_blob", uses=("media_urls",), sql="""
SELECT page_id,
  CASE page_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'reddit' ELSE 'YouTube' END AS video_provider,
  CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN url || '/fallback' ELSE url END AS video_url,
  CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE url END AS audio_url
FROM media_urls""")
def video_blob(spark, sf):
    """Video blob from the post's media: none, hosted video (fallback + dash) or a typed embed."""
    m = binding(spark, sf, "media_urls")
    media = (F.when(F.col("page_id") % 3 == 0, F.lit(None))
             .when(F.col("page_id") % 3 == 1, F.struct(
                 F.struct(F.concat("url", F.lit("/fallback")).alias("fallback_url"), F.lit(None).cast("string").alias("dash_url"))
                 .alias("reddit_video"), F.lit(None).cast("string").alias("type"),
                 F.struct(F.lit(None).cast("string").alias("provider_name")).alias("oembed")))
             .otherwise(F.struct(
                 F.lit(None).cast("struct<fallback_url:string,dash_url:string>").alias("reddit_video"),
                 F.lit("youtube.com").alias("type"), F.struct(F.lit("YouTube").alias("provider_name")).alias("oembed"))))
    b = M.video_blob(media, F.col("url"))
    return m.select("page_id", b["video_provider"].alias("video_provider"), b["video_url"].alias("video_url"),
                    b["audio_url"].alias("audio_url"))


@register("gallery_media", uses=("media_urls",), sql="""
SELECT page_id, array_to_string(list_filter([
    'm1:' || url || '/1',
    CASE WHEN page_id % 2 = 0 THEN 'm2:' || url || '/2.gif' END,
    CASE WHEN page_id % 3 <> 0 THEN 'm3:' || url || '/3' END], lambda x: x IS NOT NULL), '|') AS medias
FROM media_urls""")
def gallery_media(spark, sf):
    """valid gallery entries with a body; url = ``u`` else ``gif``."""
    m = binding(spark, sf, "media_urls")
    s = lambda u, g: F.struct(u.alias("u"), g.alias("gif"))
    meta = F.create_map(
        F.lit("m1"), F.struct(F.lit("valid").alias("status"), F.lit("image").alias("e"),
                              s(F.concat("url", F.lit("/1")), F.lit(None).cast("string")).alias("s")),
        F.lit("m2"), F.struct(F.when(F.col("page_id") % 2 == 0, "valid").otherwise("failed").alias("status"),
                              F.lit("gif").alias("e"), s(F.lit(""), F.concat("url", F.lit("/2.gif"))).alias("s")),
        F.lit("m3"), F.struct(F.lit("valid").alias("status"), F.lit("image").alias("e"),
                              F.when(F.col("page_id") % 3 != 0, s(F.concat("url", F.lit("/3")), F.lit(None).cast("string")))
                              .alias("s")))
    g = M.gallery_media(meta)
    return m.select("page_id", F.array_join(F.transform(g, lambda x: F.concat(x["id"], F.lit(":"), x["url"])), "|").alias("medias"))


@register("weekly_digest_window", uses=("versions",), sql=f"""
SELECT {_TS("time_bucket(INTERVAL 7 DAY, last_edited, TIMESTAMP '1970-01-01')")} AS window_start,
       CAST(count(*) AS BIGINT) AS n_pages, CAST(count(DISTINCT page_id) AS BIGINT) AS n_ids
FROM versions GROUP BY 1""")
def weekly_digest_window(spark, sf):
    """7-day tumbling windows by edit time (backfill form of the weekly digest look-back)."""
    v = binding(spark, sf, "versions")
    w = v.groupBy(F.window("last_edited", "7 days")).agg(F.count(F.lit(1)).alias("n_pages"),
                                                         F.count_distinct("page_id").alias("n_ids"))
    return w.select(ts_text(F.col("window.start")).alias("window_start"), F.col("n_pages").cast("bigint"),
                    F.col("n_ids").cast("bigint"))


@register("late_rows", uses=("versions", "watermarks"), sql=f"""
SELECT v.source, CAST(count_if(v.last_edited < coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY)) AS BIGINT) AS n_late,
       CAST(count_if(v.last_edited >= coalesce(w.ts, TIMESTAMP '{RUN_TS}' - INTERVAL 1 DAY)) AS BIGINT) AS n_on_time
FROM versions v LEFT JOIN watermarks w ON v.source = w.source GROUP BY v.source""")
def late_rows(spark, sf):
    """Rows older than their source's watermark are never read; counted as a side output."""
    v = binding(spark, sf, "versions")
    out = DOC.late_counts(v, binding(spark, sf, "watermarks"), "source", "last_edited",
                          default_ts=ts(RUN_TS) - F.expr("INTERVAL 1 DAY"))
    return out.select("source", F.col("n_late").cast("bigint"), F.col("n_on_time").cast("bigint"))
