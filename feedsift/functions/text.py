"""String, id, time and JSON helpers (P1-P18, P24-P34) as ``Column -> Column``.

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen; nothing leaves the JVM.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference's for equal results):
INVALID_RESPONSES = ["n/a", "None", "None."]          # model answers meaning "nothing"
BOOL_TRUE = ["yes", "true", "t", "y", "1"]
BOOL_FALSE = ["no", "false", "f", "n", "0"]
LOCAL_TZ = "America/Los_Angeles"
UNKNOWN_AUTHOR = "unknown_author"
POST_HOST = "https://www.reddit.com"

# Python's str.strip() whitespace set, as a Java regex class (trim() strips spaces only).
_WS = "[ \\t\\n\\r\\f\\u000B\\u001C\\u001D\\u001E\\u001F\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of every kind."""
    return F.regexp_replace(_c(col), f"^{_WS}+|{_WS}+$", "")


def md5_hex(col) -> Column:
    """md5 hex digest of the UTF-8 text."""
    return F.md5(_c(col))


def feed_day(raw_date) -> Column:
    """``YYYY-MM-DD`` in UTC of a feed date: RFC 822 (weekday optional, zone as offset or GMT/UT/Z) or ISO 8601 (a time
    without a zone counts as UTC); NULL if it is neither.  Independent of the session time zone."""
    raw = strip(_c(raw_date))
    m = r"^(?:[A-Za-z]{3},? +)?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}):(\d{2})(?::\d{2})? *(GMT|UTC?|Z|[+-]\d{4})$"
    iso = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::\d{2}(?:\.\d+)?)?)? *(Z|[+-]\d{2}:?\d{2})?$"
    month = F.format_string("%02d", (F.floor(F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(raw, m, 2))) / 3) + 1).cast("int"))
    rfc = F.concat_ws("-", F.regexp_extract(raw, m, 3), month, F.lpad(F.regexp_extract(raw, m, 1), 2, "0"))

    def day(date: Column, hour: Column, minute: Column, zone: Column) -> Column:
        offset = F.when(zone.rlike("^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (
            F.substring(zone, 2, 2).cast("int") * 60 + F.regexp_extract(zone, r"(\d{2})$", 1).cast("int"))).otherwise(F.lit(0))
        at = F.coalesce(F.nullif(hour, F.lit("")).cast("int"), F.lit(0)) * 60 + F.coalesce(F.nullif(minute, F.lit("")).cast("int"), F.lit(0)) - offset
        return F.date_format(F.date_add(F.try_to_date(date, "yyyy-MM-dd"), F.floor(at / 1440).cast("int")), "yyyy-MM-dd")

    x = lambda p, i: F.regexp_extract(raw, p, i)
    return F.when(raw.rlike(m), day(rfc, x(m, 4), x(m, 5), x(m, 6))).when(
        raw.rlike(iso), day(F.concat_ws("-", x(iso, 1), x(iso, 2), x(iso, 3)), x(iso, 4), x(iso, 5), x(iso, 6)))


def feed_item_id(list_name, title, raw_date) -> Column:
    """``md5(list_title_key)``; key = the UTC day of the parsed date (ISO 8601 or RFC 822), else the raw text."""
    key = F.coalesce(feed_day(raw_date), _c(raw_date))
    return F.md5(F.concat_ws("_", _c(list_name), _c(title), key))


def author_fallback(author, author_fullname) -> Column:
    """``author or author_fullname or 'unknown_author'`` (empty counts as missing)."""
    return F.coalesce(F.nullif(_c(author), F.lit("")), F.nullif(_c(author_fullname), F.lit("")),
                      F.lit(UNKNOWN_AUTHOR))


def py_float_str(col) -> Column:
    """Text of a double as Python prints it, for integral values and plain decimals.

    Integral values print as ``123.0``; other values print their shortest
    decimal digits (no exponent), like Python for magnitudes below 1e16.
    """
    c = _c(col).cast("double")
    integral = F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    frac = F.regexp_replace(F.format_string("%.6f", c), "0+$", "")
    return F.when(c == F.floor(c), integral).otherwise(frac)


def post_id(subreddit, title, author, author_fullname, ts) -> Column:
    """``md5(subreddit_title_author_ts)`` with the author fallback chain."""
    return F.md5(F.concat_ws("_", _c(subreddit), _c(title), author_fallback(author, author_fullname),
                             py_float_str(ts)))


def parse_iso(col) -> Column:
    """ISO-8601 text (``Z`` or offset) -> TIMESTAMP; empty/NULL/unparseable -> NULL."""
    c = F.nullif(_c(col), F.lit(""))
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def epoch_micros(ts) -> Column:
    """Time-zone independent rendering of an instant."""
    return F.unix_micros(_c(ts))


def truncate(col, n: int) -> Column:
    """P10: first ``n`` code points."""
    return F.substring(_c(col), 1, n)


def score_text_feed(title, list_name, summary) -> Column:
    """P5: ``f"{title} - {list} - {summary}"`` (whole; cut it with ``truncate`` where a model asks for that)."""
    return F.concat_ws(" - ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(list_name), F.lit("")),
                       F.coalesce(_c(summary), F.lit("")))


def score_text_short(reply_name, reply_text, name, text) -> Column:
    """``[reply_name: reply_text]`` + ``name: text`` with no separator between them."""
    reply = F.when(F.coalesce(_c(reply_text), F.lit("")) != "",
                   F.concat(F.coalesce(_c(reply_name), F.lit("None")), F.lit(": "), _c(reply_text))).otherwise("")
    return F.concat(reply, F.coalesce(_c(name), F.lit("None")), F.lit(": "), F.coalesce(_c(text), F.lit("None")))


def score_text_post(list_name, title, text) -> Column:
    """``f"{list} {title}: {text}"``."""
    return F.concat(_c(list_name), F.lit(" "), _c(title), F.lit(": "), _c(text))


def rank_text_post(title, text) -> Column:
    """``f"{title}: {text}"`` (the text the post rank gate measures)."""
    return F.concat(_c(title), F.lit(": "), _c(text))


def score_text_digest(title, page_text, take_aways) -> Column:
    """``f"{title}: {blocks}"`` plus ``"\\nTake aways: ..."`` when there are take-aways."""
    base = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(": "), F.coalesce(_c(page_text), F.lit("")))
    return F.when(F.coalesce(_c(take_aways), F.lit("")) != "",
                  F.concat(base, F.lit("\nTake aways: "), _c(take_aways))).otherwise(base)


def refine_text(col) -> Column:
    """Runs of newlines -> one newline, then Python strip; NULL/empty -> ''."""
    return F.coalesce(strip(F.regexp_replace(_c(col), "\n{2,}", "\n")), F.lit(""))


def label_normalise(col, n: int = 20) -> Column:
    """Commas -> spaces, first 20 characters."""
    return F.substring(F.replace(_c(col), F.lit(","), F.lit(" ")), 1, n)


def split_translation(col) -> Column:
    """struct(summary, translation) from a model answer.

    Split on ``===``; summary = part 0 stripped.  When part 0 holds several
    blank-line separated chunks, summary = first chunk and translation = the
    other chunks (each stripped, each followed by a newline); otherwise the
    translation is built the same way from the other ``===`` parts.
    """
    text = _c(col)
    parts = F.split(text, "===")
    head = strip(F.element_at(parts, 1))
    chunks = F.split(head, "\n\n")
    joined_chunks = F.array_join(F.transform(F.slice(chunks, 2, 1 << 30), lambda x: F.concat(strip(x), F.lit("\n"))), "")
    joined_parts = F.array_join(F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.concat(strip(x), F.lit("\n"))), "")
    many = F.size(chunks) > 1
    summary = F.when(many, strip(F.element_at(chunks, 1))).otherwise(head)
    translation = F.when(many, joined_chunks).otherwise(joined_parts)
    empty = text.isNull() | (text == "")
    return F.struct(F.when(empty, text).otherwise(summary).alias("summary"),
                    F.when(empty, F.lit("")).otherwise(translation).alias("translation"))


def clean_json_text(col) -> Column:
    """P13 (trap Q6): tabs removed, other characters kept; empty -> NULL."""
    return F.nullif(F.replace(_c(col), F.lit("\t"), F.lit("")), F.lit(""))


def json_valid(col) -> Column:
    """The text parses as one JSON document."""
    return F.try_parse_json(clean_json_text(col)).isNotNull()


RANK_SCHEMA = T.StructType([
    T.StructField("feedback", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StructType([
        T.StructField("topic", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))),
    T.StructField("overall_score", T.DoubleType()),
])


def lenient_json(col, schema: T.StructType = RANK_SCHEMA) -> Column:
    """Parse; unparseable or empty -> NULL (not a struct of NULLs)."""
    txt = clean_json_text(col)
    return F.when(F.try_parse_json(txt).isNotNull(), F.from_json(txt, schema))


def _or_default(x: Column, default) -> Column:
    """Python ``x or default`` for numbers: NULL and 0 count as missing (trap Q4)."""
    return F.coalesce(F.nullif(x, F.lit(0)), F.lit(default))


def parse_rank(col, *, short_post: bool = False, unparsed_rate: float = -0.01) -> Column:
    """Model rank answer -> struct(topics, categories, rate, feedback).

    topics = (topic, score or 1), categories = (category, score or 1),
    rate = overall_score, feedback or ''.  Unparseable -> [], [], -0.01.
    Short posts and posts also map a rate of 0/NULL to -0.01.
    """
    j = lenient_json(col)
    label = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))
    topics = F.transform(F.coalesce(j["topics"], F.array()),
                         lambda x: F.struct(x["topic"].alias("name"), _or_default(x["score"], 1.0).alias("score")))
    cats = F.transform(F.coalesce(j["topics"], F.array()),
                       lambda x: F.struct(x["category"].alias("name"), _or_default(x["score"], 1.0).alias("score")))
    rate = j["overall_score"]
    if short_post:
        rate = _or_default(rate, unparsed_rate)
    empty = F.array().cast(label)
    return F.when(j.isNull(), F.struct(empty.alias("topics"), empty.alias("categories"),
                                       F.lit(unparsed_rate).alias("rate"), F.lit("").alias("feedback"))
                  ).otherwise(F.struct(topics.cast(label).alias("topics"), cats.cast(label).alias("categories"),
                                       rate.cast("double").alias("rate"),
                                       F.coalesce(F.nullif(j["feedback"], F.lit("")), F.lit("")).alias("feedback")))


def scale_rate(source, rate) -> Column:
    """x100 for short posts and posts; raw for articles and videos; ``rate or -1`` for feeds."""
    s = F.lower(_c(source))
    r = _c(rate).cast("double")
    return (F.when(s.isin("twitter", "reddit"), r * 100)
            .when(s == "rss", _or_default(r, -1.0))
            .otherwise(r))


def to_local_time(ts) -> Column:
    """UTC wall-clock time (TIMESTAMP_NTZ) -> Los Angeles wall-clock time; independent of the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), _c(ts))


def parse_bool(col) -> Column:
    """yes/true/t/y/1 -> true, no/false/f/n/0 -> false, anything else is an error."""
    v = F.lower(_c(col))
    return (F.when(v.isin(*BOOL_TRUE), F.lit(True))
            .when(v.isin(*BOOL_FALSE), F.lit(False))
            .otherwise(F.raise_error(F.concat(F.lit("Unsupported value: "), F.coalesce(_c(col), F.lit("NULL"))))
                       .cast("boolean")))


def url_repair(url, title=None) -> Column:
    """``/r/...`` gets the host, ``&feature=share`` removed, spaces stripped, title when url empty."""
    u = _c(url)
    u = F.when(u.startswith("/r/"), F.concat(F.lit(POST_HOST), u)).otherwise(u)
    u = F.replace(F.replace(u, F.lit("&feature=share"), F.lit("")), F.lit(" "), F.lit(""))
    if title is not None:
        u = F.coalesce(F.nullif(u, F.lit("")), _c(title))
    return u


def paper_id(url) -> Column:
    """P25: paper id from an ``https://arxiv.org`` url: last path part, no ``.pdf``, cut at the first ``v``."""
    u = _c(url)
    last = F.replace(F.substring_index(u, "/", -1), F.lit(".pdf"), F.lit(""))
    cut = F.when(F.instr(last, "v") > 0, F.substring(last, 1, F.instr(last, "v") - 1)).otherwise(last)
    return F.when(u.startswith("https://arxiv.org"), cut)


def html_unescape_basic(col) -> Column:
    """The five common HTML entities, in the JVM (``&amp;`` last so it is not applied twice)."""
    c = _c(col)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def html_unescape_full(col) -> Column:
    """P26 (the rest): every HTML5 character reference, decoded by the standard library in an Arrow-batched
    pandas UDF.  Use after ``html_unescape_basic`` only where a ``&`` is left (the JVM path covers the usual five)."""
    @F.pandas_udf(T.StringType())
    def unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else html.unescape(v))

    return unescape(_c(col))


def collection_name(model, as_of, prefix: str = "news") -> Column:
    """``{prefix}_{model with \\W+ -> _}__{date with - -> _}``."""
    return F.concat(F.lit(prefix + "_"), F.regexp_replace(_c(model), r"\W+", "_"), F.lit("__"),
                    F.replace(F.date_format(_c(as_of), "yyyy-MM-dd"), F.lit("-"), F.lit("_")))


def collection_date(name) -> Column:
    """P27 inverse: the date after the last ``__``."""
    return F.to_date(F.replace(F.substring_index(_c(name), "__", -1), F.lit("_"), F.lit("-")))


def duration_minutes(seconds) -> Column:
    """Seconds / 60 with 2 decimals, as text."""
    return F.format_string("%.2f", _c(seconds).cast("double") / 60)


def post_metadata(subreddit, author, ups, downs, num_comments) -> Column:
    """Metadata comment of a post."""
    py = lambda x: F.coalesce(_c(x).cast("string"), F.lit("None"))  # noqa: E731  (Python prints None)
    return F.format_string("Subreddit: %s\nAuthor: %s\nUps: %s\nDowns: %s\nNumOfComments: %s",
                           py(subreddit), py(author), py(ups), py(downs), py(num_comments))


def build_prompt(template: str, content) -> Column:
    """A literal template with ``{content}`` replaced by the column."""
    return F.replace(F.lit(template), F.lit("{content}"), _c(content))


def with_header(text, header: str) -> Column:
    """Prepend ``header + newline`` unless the text already contains the header."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(F.contains(t, F.lit(header)), t).otherwise(F.concat(F.lit(header + "\n"), t))


def journal_content(title, content) -> Column:
    """``f"{title} {content}"``."""
    return F.concat_ws(" ", F.coalesce(_c(title), F.lit("None")), F.coalesce(_c(content), F.lit("None")))


def bytes_to_text(col) -> Column:
    """UTF-8 decode of a cached binary value."""
    return F.decode(_c(col), "UTF-8")
