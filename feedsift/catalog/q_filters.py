"""Filter, gate and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.catalog.util import RUN_TS, ts
from feedsift.operators import filters as FL
from feedsift.operators import stats as ST
from feedsift.operators.dedup import visited_flags
from feedsift.sources.scans import sync_rated

OVERRIDES = "src0:3,src3:4.5,bad,src5:0"
_OVR_SQL = (", o AS (SELECT split_part(e, ':', 1) AS list_name, CAST(split_part(e, ':', 2) AS DOUBLE) AS min_score "
            f"FROM (SELECT unnest(string_split('{OVERRIDES}', ',')) AS e) WHERE len(string_split(e, ':')) >= 2)")


@register("relevance_topk", uses=("scored",), sql="""
SELECT id, relevant_score FROM scored WHERE relevant_score < 0 OR relevant_score >= 4
ORDER BY relevant_score DESC, id LIMIT 1""")
def relevance_topk(spark, sf):
    """Feed filter, production k=1: unknown or >= 4, best score first (ties by id)."""
    s = binding(spark, sf, "scored")
    return FL.relevance_topk(s, "relevant_score", "id", k=1, min_score=4.0).select("id", "relevant_score")


@register("per_list_threshold", uses=("scored",), sql=_OVR_SQL + """
SELECT s.id, s.list_name FROM scored s LEFT JOIN o ON s.list_name = o.list_name
WHERE s.relevant_score < 0 OR s.relevant_score >= coalesce(nullif(o.min_score, 0), 4.0)""")
def per_list_threshold(spark, sf):
    """Per-list minimum from the override spec, default 4; an override of 0 falls back."""
    s = binding(spark, sf, "scored")
    return FL.per_list_threshold(s, FL.parse_overrides(spark, OVERRIDES)).select("id", "list_name")


@register("digest_prefilter", uses=("rated_pages",), sql="""
SELECT arrival FROM rated_pages WHERE CAST(user_rating AS INTEGER) >= 4 OR coalesce(take_aways, '') <> ''""")
def digest_prefilter(spark, sf):
    """rating >= 4 or take-aways present."""
    return FL.digest_prefilter(binding(spark, sf, "rated_pages")).select("arrival")


_LATEST_RATED = """
, latest AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY last_edited_time DESC, arrival ASC) AS rn FROM rated_pages
    WHERE user_rating IS NOT NULL AND user_rating <> '') WHERE rn = 1)"""


def _latest_rated(spark, sf):
    p = binding(spark, sf, "rated_pages").select("id", "arrival", "source", "user_rating", "last_edited_time",
                                                 "relevant", "take_aways", "tags")
    return sync_rated(p)


@register("digest_postfilter", uses=("rated_pages",), sql=_LATEST_RATED + """
SELECT id, round(CAST(user_rating AS INTEGER) * 0.8 + relevant / 10.0 * 0.2, 6) AS sorting_score FROM latest
WHERE CAST(user_rating AS INTEGER) * 0.8 + relevant / 10.0 * 0.2 >= 4.5
ORDER BY relevant DESC, id LIMIT 10""")
def digest_postfilter(spark, sf):
    """sorting score 0.8 rating + 0.2 relevance >= 4.5, ordered by relevance, first 10."""
    p = _latest_rated(spark, sf).withColumn("relevant_score", F.col("relevant") / 10.0)
    out = FL.digest_postfilter(p.withColumn("user_rating", F.col("user_rating").cast("int")))
    return out.select("id", F.round("sorting_score", 6).alias("sorting_score"))


@register("takeaway_pages", uses=("rated_pages",), sql="""
SELECT arrival, take_aways AS content FROM rated_pages WHERE length(coalesce(take_aways, '')) > 0""")
def takeaway_pages(spark, sf):
    """pages with take-aways, which become the content."""
    return FL.takeaway_pages(binding(spark, sf, "rated_pages")).select("arrival", "content")


@register("rating_floor", uses=("rated_pages",), sql=_LATEST_RATED + """
SELECT CAST(count_if(CAST(user_rating AS INTEGER) >= 4) AS BIGINT) AS kept,
       CAST(count_if(NOT CAST(user_rating AS INTEGER) >= 4) AS BIGINT) AS skipped FROM latest""")
def rating_floor(spark, sf):
    """rating floor 4 with the skipped count (latest rated versions)."""
    out = FL.rating_floor_counts(_latest_rated(spark, sf))
    return out.select(F.col("kept").cast("bigint"), F.col("skipped").cast("bigint"))


@register("exclude_source_tag", uses=("rated_pages",), sql="""
SELECT arrival FROM rated_pages WHERE source NOT IN ('error', 'signup') AND NOT list_contains(tags, 'action:deepdive')""")
def exclude_source_tag(spark, sf):
    """F8: drop the excluded sources (here the event types standing in for TODO/Journal) and deep-dive tags."""
    out = FL.exclude_source_tag(binding(spark, sf, "rated_pages"), sources=["error", "signup"])
    return out.select("arrival")


@register("include_tag", uses=("rated_pages",), sql="""
SELECT arrival FROM rated_pages WHERE list_contains(tags, 'action:deepdive')""")
def include_tag(spark, sf):
    """pages tagged for a deep dive."""
    return FL.include_tag(binding(spark, sf, "rated_pages")).select("arrival")


@register("drop_invalid_response", uses=("action_lists",), sql="""
, l AS (SELECT id, unnest(string_split(todo, chr(10))) AS line, generate_subscripts(string_split(todo, chr(10)), 1) AS pos
        FROM action_lists)
SELECT id, CAST(pos AS INTEGER) AS pos, line FROM l
WHERE NOT (regexp_replace(line, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') IN ('', 'n/a', 'None', 'None.'))""")
def drop_invalid_response(spark, sf):
    """lines of a model answer without the blank / 'n/a' / 'None' / 'None.' ones."""
    a = binding(spark, sf, "action_lists")
    lines = a.select("id", F.posexplode(F.split("todo", "\n")).alias("p0", "line"))
    out = lines.where(~FL.is_invalid_response(F.col("line")))
    return out.select("id", (F.col("p0") + 1).cast("int").alias("pos"), "line")


@register("rank_gate", uses=("scored", "items"), sql="""
SELECT s.id, (s.relevant_score > 0 AND s.relevant_score < 4) AS gated,
       CASE WHEN s.relevant_score > 0 AND s.relevant_score < 4 THEN CAST(-0.02 AS DOUBLE) END AS rate
FROM scored s JOIN items i ON s.id = i.id""")
def rank_gate(spark, sf):
    """low score -> no model call, rate -0.02."""
    s = binding(spark, sf, "scored").join(binding(spark, sf, "items").select("id", "body"), "id")
    g = FL.rank_gate(F.col("relevant_score"), F.col("body"))
    return s.select("id", g.alias("gated"), F.when(g, F.lit(-0.02)).alias("rate"))


@register("summary_gate", uses=("items", "cache"), sql="""
SELECT i.id, CASE WHEN c.item_id IS NOT NULL THEN 'cached' WHEN coalesce(i.body, '') = '' THEN 'drop'
                  ELSE 'summarise' END AS action
FROM items i LEFT JOIN (SELECT item_id FROM cache WHERE NOT expired) c ON i.id = c.item_id""")
def summary_gate(spark, sf):
    """short texts pass unsummarised, empty ones drop, cached ones reuse the cache."""
    i = binding(spark, sf, "items")
    c = binding(spark, sf, "cache").where(~F.col("expired")).select(F.col("item_id").alias("id"), F.lit(True).alias("hit"))
    j = i.join(c, "id", "left")
    return j.select("id", FL.summary_action(F.col("body"), F.coalesce(F.col("hit"), F.lit(False))).alias("action"))


@register("recent_evidence", uses=("notes",), sql=f"""
SELECT source, id FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(content) DESC, id) AS rn FROM notes
  WHERE created_time >= TIMESTAMP '{RUN_TS}' - INTERVAL 3650 DAY) WHERE rn <= 5""")
def recent_evidence(spark, sf):
    """published within 3650 days, top 5 per topic by relevance (here text length)."""
    n = binding(spark, sf, "notes").withColumn("relevance", F.length("content"))
    out = FL.recent_topk(n, "source", "created_time", "relevance", "id", now=ts(RUN_TS), days=3650, k=5)
    return out.select("source", "id")


@register("exclude_site", uses=(), sql="""
SELECT page_id, CASE WHEN contains(url, 'twitch.tv') OR contains(url, 'example.net') THEN '' ELSE url END AS url FROM pages""")
def exclude_site(spark, sf):
    """F16: urls of blocked hosts become empty (blocked list plus one fixture host)."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", FL.exclude_site(F.col("url"), FL.EXCLUDED_SITES + ["example.net"]).alias("url"))


# ---------------------------------------------------------------- statistics
_FUNNEL_SQL = _OVR_SQL + """
, f AS (
  SELECT i.list_name, s.relevant_score, v.item_id IS NULL AS deduped,
         v.item_id IS NULL AND (s.relevant_score < 0 OR s.relevant_score >= coalesce(nullif(o.min_score, 0), 4.0)) AS filtered,
         length(coalesce(i.body, '')) > 0 AS has_text
  FROM items i JOIN scored s ON i.id = s.id LEFT JOIN visited v ON v.item_id = i.id AND v.list_name = i.list_name
  LEFT JOIN o ON i.list_name = o.list_name)
, c AS (SELECT list_name, count(*) AS total_input, count_if(deduped) AS post_deduping, count_if(deduped) AS post_scoring,
               count_if(filtered) AS post_filtering, count_if(filtered AND has_text) AS post_summary,
               count_if(filtered AND has_text AND NOT coalesce(relevant_score > 0 AND relevant_score < 4, false)) AS post_ranking, count_if(filtered) AS total_pushed
        FROM f GROUP BY list_name)
SELECT list_name, stage, CAST(n AS BIGINT) AS n FROM c
UNPIVOT (n FOR stage IN (total_input, post_deduping, post_scoring, post_filtering, post_summary, post_ranking, total_pushed))"""


@register("funnel_counts", uses=("items", "scored", "visited"), sql=_FUNNEL_SQL)
def funnel_counts(spark, sf):
    """A3: seven stage counters per list in one aggregation pass, long form."""
    items = binding(spark, sf, "items").join(binding(spark, sf, "scored").select("id", "relevant_score"), "id")
    f = visited_flags(items, binding(spark, sf, "visited"), {"id": "item_id", "list_name": "list_name"})
    f = FL.with_list_min(f, FL.parse_overrides(spark, OVERRIDES))
    deduped = ~F.col("is_visited")
    filtered = deduped & FL.passes_min(F.col("relevant_score"), F.col("min_score"))
    has_text = F.length(F.coalesce(F.col("body"), F.lit(""))) > 0
    ranked = filtered & has_text & ~FL.rank_gate(F.col("relevant_score"), F.col("body"))
    flags = {"total_input": F.lit(True), "post_deduping": deduped, "post_scoring": deduped,
             "post_filtering": filtered, "post_summary": filtered & has_text, "post_ranking": ranked,
             "total_pushed": filtered}
    return ST.funnel_counts(f, ["list_name"], flags)


@register("rate_histogram", uses=("scored",), sql="""
, b AS (SELECT list_name, relevant_score / 5 AS rate FROM scored)
SELECT list_name, CASE WHEN rate <= 0.5 THEN 'below_0.5' WHEN rate <= 0.6 THEN 'below_0.6' WHEN rate <= 0.7 THEN 'below_0.7'
                       WHEN rate <= 0.8 THEN 'below_0.8' WHEN rate <= 0.9 THEN 'below_0.9' ELSE 'below_1' END AS bucket,
       CAST(count(*) AS BIGINT) AS n
FROM b WHERE rate <= 1 GROUP BY ALL""")
def rate_histogram(spark, sf):
    """A4: rate buckets per list; negative sentinels count as below 0.5, > 1 uncounted."""
    s = binding(spark, sf, "scored").select("list_name", (F.col("relevant_score") / 5).alias("rate"))
    return ST.rate_histogram(s, ["list_name"])


@register("publish_stats", uses=("items", "scored"), sql="""
SELECT i.list_name, CAST(count(*) AS BIGINT) AS total, CAST(count_if(coalesce(i.title, '') = '' OR i.lang = 'de') AS BIGINT) AS error
FROM items i JOIN scored s ON i.id = s.id WHERE s.relevant_score < 0 OR s.relevant_score >= 4 GROUP BY i.list_name""")
def publish_stats(spark, sf):
    """Publish attempts per list with per-row isolated errors (the stand-in target rejects one language and untitled rows)."""
    from feedsift.sinks.publish import publish_attempts

    items = binding(spark, sf, "items").join(binding(spark, sf, "scored").select("id", "relevant_score"), "id")
    attempts = publish_attempts(items.where(FL.passes_min(F.col("relevant_score"), 4.0)), rejected=F.when((F.coalesce("title", F.lit("")) == "") | (F.col("lang") == "de"), F.lit("rejected")))
    return ST.publish_tallies(attempts, ["list_name"]).select(
        "list_name", F.col("total").cast("bigint"), F.col("error").cast("bigint"))


@register("collection_stats", uses=("vectors",), sql="""
SELECT model, as_of, CAST(count(*) AS BIGINT) AS n_rows, false AS is_empty FROM vectors GROUP BY model, as_of""")
def collection_stats(spark, sf):
    """Rows per dated collection."""
    out = ST.collection_stats(binding(spark, sf, "vectors"))
    return out.select("model", "as_of", F.col("n_rows").cast("bigint"), "is_empty")

