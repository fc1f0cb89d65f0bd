"""Scalar function queries (P1-P33, T1, T2) over the fixture bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.functions import labels as L
from feedsift.functions import media as M
from feedsift.functions import text as X

# DuckDB spelling of Python's strip() on the fixture texts.
_STRIP = "regexp_replace({x}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


@register("hash_ids", uses=("items",), sql="SELECT id, md5(body) AS hash FROM items")
def hash_ids(spark, sf):
    """md5 hex of each item body."""
    return binding(spark, sf, "items").select("id", X.md5_hex("body").alias("hash"))


@register("feed_item_id", uses=("feed_entries",), sql="""
SELECT feed, pos, md5(concat_ws('_', feed, title,
       coalesce(strftime(try_strptime(substr(raw_date, 6, 20), '%d %b %Y %H:%M:%S')
           - CASE substr(raw_date, 27) WHEN '-0500' THEN INTERVAL (-5) HOUR WHEN '+0900' THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d'), raw_date))) AS item_id
FROM feed_entries""")
def feed_item_id(spark, sf):
    """Feed item id from list, title and the day of the published date (raw text if unparsed)."""
    return binding(spark, sf, "feed_entries").select(
        "feed", "pos", X.feed_item_id("feed", "title", "raw_date").alias("item_id"))


_PYFLOAT = ("CASE WHEN ts = floor(ts) THEN CAST(CAST(ts AS BIGINT) AS VARCHAR) || '.0' "
            "ELSE regexp_replace(printf('%.6f', ts), '0+$', '') END")


@register("post_id", uses=("posts",), sql=f"""
SELECT id, coalesce(nullif(author, ''), nullif(author_fullname, ''), 'unknown_author') AS author_used,
       md5(concat_ws('_', subreddit, title, coalesce(nullif(author, ''), nullif(author_fullname, ''), 'unknown_author'),
                     {_PYFLOAT})) AS post_id
FROM posts""")
def post_id(spark, sf):
    """Post id with the author fallback chain and the timestamp printed as Python prints a float."""
    p = binding(spark, sf, "posts")
    return p.select("id", X.author_fallback("author", "author_fullname").alias("author_used"),
                    X.post_id("subreddit", "title", "author", "author_fullname", "ts").alias("post_id"))


@register("parse_iso", uses=("short_posts",), sql="""
SELECT list_id, tweet_id, created_at,
       epoch_us(CAST(nullif(created_at, '') AS TIMESTAMPTZ)) AS epoch_us
FROM short_posts""")
def parse_iso(spark, sf):
    """ISO-8601 with ``Z`` or an offset -> instant (as epoch microseconds); empty -> NULL."""
    p = binding(spark, sf, "short_posts")
    return p.select("list_id", "tweet_id", "created_at", X.epoch_micros(X.parse_iso("created_at")).alias("epoch_us"))


@register("to_local_time", uses=("versions",), sql="""
SELECT arrival, strftime(timezone('America/Los_Angeles', timezone('UTC', last_edited)), '%Y-%m-%d %H:%M:%S.%f') AS local_time
FROM versions""")
def to_local_time(spark, sf):
    """UTC wall-clock time -> Los Angeles wall-clock time."""
    v = binding(spark, sf, "versions")
    local = X.to_local_time(F.col("last_edited"))
    return v.select("arrival", F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("local_time"))


@register("score_text_feed", uses=("items",), sql="""
SELECT id, title || ' - ' || list_name || ' - ' || body AS score_text FROM items""")
def score_text_feed(spark, sf):
    """P5: feed score text, whole."""
    return binding(spark, sf, "items").select("id", X.score_text_feed("title", "list_name", "body").alias("score_text"))


@register("score_text_post", uses=("posts",), sql="""
SELECT id, subreddit || ' ' || title || ': ' || text AS score_text, title || ': ' || text AS rank_text FROM posts""")
def score_text_post(spark, sf):
    """Post score text and rank text."""
    p = binding(spark, sf, "posts")
    return p.select("id", X.score_text_post("subreddit", "title", "text").alias("score_text"),
                    X.rank_text_post("title", "text").alias("rank_text"))


@register("refine_text", uses=("summaries",), sql=f"""
SELECT id, coalesce({_strip("regexp_replace(summary, '\\n{2,}', chr(10), 'g')")}, '') AS refined FROM summaries""")
def refine_text(spark, sf):
    """Collapse blank lines, strip all whitespace."""
    return binding(spark, sf, "summaries").select("id", X.refine_text("summary").alias("refined"))


@register("truncate_text", uses=("items",), sql="""
SELECT id, CAST(length(substr(body, 1, 20000)) AS BIGINT) AS n_summary, CAST(length(substr(body, 1, 5000)) AS BIGINT) AS n_embed,
       md5(substr(body, 1, 1024)) AS score_hash
FROM items""")
def truncate_text(spark, sf):
    """P10: content 20000, embedding input 5000, score text 1024 characters."""
    i = binding(spark, sf, "items")
    return i.select("id", F.length(X.truncate("body", 20000)).cast("bigint").alias("n_summary"),
                    F.length(X.truncate("body", 5000)).cast("bigint").alias("n_embed"),
                    F.md5(X.truncate("body", 1024)).alias("score_hash"))


@register("split_translation", uses=("summaries",), sql=f"""
SELECT id,
  CASE WHEN summary IS NULL OR summary = '' THEN summary
       WHEN len(string_split({_strip("string_split(summary, '===')[1]")}, chr(10) || chr(10))) > 1
       THEN {_strip("string_split(" + _strip("string_split(summary, '===')[1]") + ", chr(10) || chr(10))[1]")}
       ELSE {_strip("string_split(summary, '===')[1]")} END AS summary,
  CASE WHEN summary IS NULL OR summary = '' THEN ''
       WHEN len(string_split({_strip("string_split(summary, '===')[1]")}, chr(10) || chr(10))) > 1
       THEN array_to_string(list_transform(string_split({_strip("string_split(summary, '===')[1]")}, chr(10) || chr(10))[2:],
                                           lambda x: {_strip("x")} || chr(10)), '')
       ELSE array_to_string(list_transform(string_split(summary, '===')[2:], lambda x: {_strip("x")} || chr(10)), '') END
    AS translation
FROM summaries""")
def split_translation(spark, sf):
    """Summary / translation split of a model answer."""
    s = binding(spark, sf, "summaries")
    st = X.split_translation("summary")
    return s.select("id", st["summary"].alias("summary"), st["translation"].alias("translation"))


_RANK_T = ("json_transform(replace(answer, chr(9), ''), "
           "'{\"feedback\":\"VARCHAR\",\"topics\":[{\"topic\":\"VARCHAR\",\"category\":\"VARCHAR\",\"score\":\"DOUBLE\"}],"
           "\"overall_score\":\"DOUBLE\"}')")


@register("lenient_json", uses=("rank_json",), sql="""
SELECT id, coalesce(json_valid(nullif(replace(answer, chr(9), ''), '')), false) AS valid FROM rank_json""")
def lenient_json(spark, sf):
    """Empty -> NULL, tabs removed, parse failure -> NULL (reported as ``valid``)."""
    r = binding(spark, sf, "rank_json")
    return r.select("id", F.coalesce(X.lenient_json("answer").isNotNull(), F.lit(False)).alias("valid"))


@register("parse_rank_json", uses=("rank_json",), sql=f"""
WITH_PARSED
SELECT id,
  CASE WHEN NOT ok THEN '' ELSE coalesce(array_to_string(list_transform(j.topics, lambda x: x.topic || ':' || printf('%.6f', coalesce(nullif(x.score, 0), 1.0))), '|'), '') END AS topics,
  CASE WHEN NOT ok THEN '' ELSE coalesce(array_to_string(list_transform(j.topics, lambda x: x.category || ':' || printf('%.6f', coalesce(nullif(x.score, 0), 1.0))), '|'), '') END AS categories,
  CASE WHEN NOT ok THEN -0.01 ELSE j.overall_score END AS rate,
  CASE WHEN NOT ok THEN -0.01 ELSE coalesce(nullif(j.overall_score, 0), -0.01) END AS rate_short,
  CASE WHEN NOT ok THEN '' ELSE coalesce(j.feedback, '') END AS feedback
FROM parsed""".replace("WITH_PARSED", f", parsed AS (SELECT id, coalesce(json_valid(nullif(replace(answer, chr(9), ''), '')), false) AS ok, "
                                      f"CASE WHEN json_valid(nullif(replace(answer, chr(9), ''), '')) THEN {_RANK_T} END AS j FROM rank_json)"))
def parse_rank_json(spark, sf):
    """topics/categories with score-or-1, rate, feedback; unparseable -> [], [], -0.01."""
    r = binding(spark, sf, "rank_json")
    a = X.parse_rank("answer")
    s = X.parse_rank("answer", short_post=True)
    return r.select("id", L.render_labels(a["topics"]).alias("topics"), L.render_labels(a["categories"]).alias("categories"),
                    a["rate"].alias("rate"), s["rate"].alias("rate_short"), a["feedback"].alias("feedback"))


_SOURCES = "CASE id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' WHEN 2 THEN 'rss' ELSE 'article' END"


@register("scale_rate", uses=("rank_json",), sql=f"""
, parsed AS (SELECT id, {_SOURCES} AS source,
             CASE WHEN json_valid(nullif(replace(answer, chr(9), ''), '')) THEN {_RANK_T}.overall_score ELSE -0.01 END AS rate
             FROM rank_json)
SELECT id, source, CASE WHEN source IN ('twitter', 'reddit') THEN rate * 100
                        WHEN source = 'rss' THEN coalesce(nullif(rate, 0), -1.0) ELSE rate END AS scaled
FROM parsed""")
def scale_rate(spark, sf):
    """Rate x100 for short posts and posts, raw for articles, ``rate or -1`` for feeds."""
    r = binding(spark, sf, "rank_json").withColumn("source", F.expr(_SOURCES))
    rate = X.parse_rank("answer")["rate"]
    return r.select("id", "source", X.scale_rate("source", rate).alias("scaled"))


BOOL_TEXTS = ["yes", "TRUE", "t", "Y", "1", "no", "False", "f", "N", "0"]
_BOOLS = "[" + ", ".join(f"'{x}'" for x in BOOL_TEXTS) + "]"


@register("parse_bool", uses=("versions",), sql=f"""
, t AS (SELECT arrival, ({_BOOLS})[CAST(arrival % 10 AS INT) + 1] AS txt FROM versions)
SELECT arrival, txt, lower(txt) IN ('yes', 'true', 't', 'y', '1') AS value FROM t""")
def parse_bool(spark, sf):
    """Boolean texts (case-insensitive); unknown text raises."""
    v = binding(spark, sf, "versions")
    t = v.select("arrival", F.element_at(F.array(*[F.lit(x) for x in BOOL_TEXTS]),
                                         (F.col("arrival") % 10 + 1).cast("int")).alias("txt"))
    return t.select("arrival", "txt", X.parse_bool("txt").alias("value"))


@register("media_flags", uses=("media_urls",), sql="""
SELECT page_id,
  has_media OR contains(url, 'https://v.redd.it') AS is_video,
  suffix(url, 'jpg') OR suffix(url, 'png') OR suffix(url, 'gif') OR contains(url, 'https://i.redd.it') AS is_image,
  contains(url, 'www.reddit.com/gallery') AS is_gallery,
  NOT contains(url, 'https://www.reddit.com') AND NOT contains(url, '.redd.it') AS is_external
FROM media_urls""")
def media_flags(spark, sf):
    """Video, image, gallery and external-link predicates."""
    m = binding(spark, sf, "media_urls")
    return m.select("page_id", M.is_video("has_media", F.lit(False), "url").alias("is_video"),
                    M.is_image("url").alias("is_image"), M.is_gallery(F.lit(None).cast("boolean"), "url").alias("is_gallery"),
                    M.is_external_link("url").alias("is_external"))


@register("url_repair", uses=("media_urls",), sql="""
SELECT page_id, replace(replace(CASE WHEN starts_with(url, '/r/') THEN 'https://www.reddit.com' || url ELSE url END,
                                '&feature=share', ''), ' ', '') AS url
FROM media_urls""")
def url_repair(spark, sf):
    """Relative post urls get the host; share suffix and spaces removed."""
    return binding(spark, sf, "media_urls").select("page_id", X.url_repair("url").alias("url"))


@register("paper_id", uses=("media_urls",), sql="""
, t AS (SELECT page_id, url, replace(string_split(url, '/')[-1], '.pdf', '') AS last FROM media_urls)
SELECT page_id, CASE WHEN starts_with(url, 'https://arxiv.org')
                     THEN CASE WHEN strpos(last, 'v') > 0 THEN substr(last, 1, strpos(last, 'v') - 1) ELSE last END END AS paper_id
FROM t""")
def paper_id(spark, sf):
    """P25: paper id: last path part without ``.pdf``, cut at the first ``v``."""
    return binding(spark, sf, "media_urls").select("page_id", X.paper_id("url").alias("paper_id"))


@register("html_unescape", uses=(), sql="""
SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1),
       '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&') AS title
FROM pages""")
def html_unescape(spark, sf):
    """Unescape the page title's HTML entities."""
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", X.html_unescape_basic(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@register("collection_name", uses=("vectors",), sql="""
SELECT DISTINCT model, as_of, 'news_' || regexp_replace(model, '\\W+', '_', 'g') || '__' || replace(strftime(as_of, '%Y-%m-%d'), '-', '_') AS name,
       CAST(replace(string_split('news_' || model || '__' || replace(strftime(as_of, '%Y-%m-%d'), '-', '_'), '__')[-1], '_', '-') AS DATE) AS parsed
FROM vectors""")
def collection_name(spark, sf):
    """Dated collection name and its inverse."""
    v = binding(spark, sf, "vectors").select("model", "as_of").distinct()
    name = X.collection_name("model", "as_of")
    return v.select("model", "as_of", name.alias("name"), X.collection_date(name).alias("parsed"))


@register("format_metadata", uses=("posts",), sql="""
SELECT id, printf('%.2f', CAST(length(text) AS DOUBLE) / 60) AS duration,
       printf('Subreddit: %s' || chr(10) || 'Author: %s' || chr(10) || 'Ups: %s' || chr(10) || 'Downs: %s' || chr(10) || 'NumOfComments: %s',
              subreddit, coalesce(author_fullname, 'None'), CAST(length(text) AS VARCHAR), CAST(length(title) AS VARCHAR), CAST(length(subreddit) AS VARCHAR)) AS metadata
FROM posts""")
def format_metadata(spark, sf):
    """Duration in minutes with 2 decimals and the post metadata comment."""
    p = binding(spark, sf, "posts")
    return p.select("id", X.duration_minutes(F.length("text")).alias("duration"),
                    X.post_metadata("subreddit", "author_fullname", F.length("text"), F.length("title"),
                                    F.length("subreddit")).alias("metadata"))


PROMPT = "Rate the quality of the text from 0 to 1 and name its topics. Answer in JSON.\nText: {content}"


@register("build_prompt", uses=("items",), sql=f"""
SELECT id, md5(replace('{PROMPT.replace(chr(10), "' || chr(10) || '")}', '{{content}}', body)) AS prompt_md5
FROM items""")
def build_prompt(spark, sf):
    """prompt = template with the whole content substituted."""
    i = binding(spark, sf, "items")
    return i.select("id", F.md5(X.build_prompt(PROMPT, F.col("body"))).alias("prompt_md5"))


@register("assemble_sections", uses=("action_lists", "summaries"), sql="""
SELECT a.id,
  CASE WHEN contains(a.todo, 'Action Items') THEN a.todo ELSE 'Action Items' || chr(10) || a.todo END AS todo_section,
  CASE WHEN contains(s.summary, 'Takeaways') THEN s.summary ELSE 'Takeaways' || chr(10) || s.summary END AS takeaway_section
FROM action_lists a JOIN summaries s ON a.id = s.id""")
def assemble_sections(spark, sf):
    """Prepend a section header only when the text does not already contain it."""
    a = binding(spark, sf, "action_lists")
    s = binding(spark, sf, "summaries")
    return a.join(s, "id").select("id", X.with_header("todo", "Action Items").alias("todo_section"),
                                  X.with_header("summary", "Takeaways").alias("takeaway_section"))


@register("journal_content", uses=("notes",), sql="SELECT id, title || ' ' || content AS content FROM notes")
def journal_content(spark, sf):
    """Journal text ``"{title} {content}"``."""
    return binding(spark, sf, "notes").select("id", X.journal_content("title", "content").alias("content"))


# ---- label arrays (T1, T2, P11): labels = words of the title with a score of length % 3
_WORDS = "list_transform(string_split(title, ' '), lambda w: {'name': w, 'score': CAST(length(w) % 3 AS DOUBLE)})"


@register("topk_labels", uses=("items",), sql="""
, w AS (SELECT id, u.w AS name, CAST(length(u.w) % 3 AS DOUBLE) AS score, u.pos
        FROM items, LATERAL (SELECT unnest(string_split(title, ' ')) AS w, generate_subscripts(string_split(title, ' '), 1) AS pos) u)
, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rk FROM w)
SELECT i.id, coalesce(string_agg(substr(replace(r.name, ',', ' '), 1, 20) || ':' || printf('%.6f', r.score), '|' ORDER BY r.rk), '') AS labels
FROM items i LEFT JOIN r ON i.id = r.id AND r.rk <= 3 GROUP BY i.id""")
def topk_labels(spark, sf):
    """T1 + P11: stable top-3 labels by score, names normalised."""
    i = binding(spark, sf, "items")
    lab = F.transform(F.split("title", " "), lambda w: F.struct(w.alias("name"), (F.length(w) % 3).cast("double").alias("score")))
    top = L.topk_labels(lab, 3)
    top = F.transform(top, lambda x: F.struct(X.label_normalise(x["name"]).alias("name"), x["score"].alias("score")))
    return i.select("id", L.render_labels(top).alias("labels"))


@register("firstk_tags", uses=("items",), sql="""
SELECT id, array_to_string(string_split(title, ' ')[1:3], '|') AS tags FROM items""")
def firstk_tags(spark, sf):
    """The first 3 tags, no sorting."""
    i = binding(spark, sf, "items")
    return i.select("id", F.array_join(L.firstk(F.split("title", " "), 3), "|").alias("tags"))
