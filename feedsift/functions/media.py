"""Post media predicates and blobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (hosts and suffixes the reference tests for):
VIDEO_HOST = "https://v.redd.it"
IMAGE_SUFFIXES = ["jpg", "png", "gif"]
IMAGE_HOST = "https://i.redd.it"
GALLERY_PATH = "www.reddit.com/gallery"
INTERNAL_MARKERS = ["https://www.reddit.com", ".redd.it"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_video(has_media, video_flag, url) -> Column:
    """Media present OR video flag OR a hosted-video url."""
    return (F.coalesce(_c(has_media), F.lit(False)) | F.coalesce(_c(video_flag), F.lit(False))
            | F.contains(F.coalesce(_c(url), F.lit("")), F.lit(VIDEO_HOST)))


def is_image(url) -> Column:
    """P20: url ends with jpg/png/gif (no dot required) or contains the image host."""
    u = F.coalesce(_c(url), F.lit(""))
    cond = F.contains(u, F.lit(IMAGE_HOST))
    for s in IMAGE_SUFFIXES:
        cond = cond | F.endswith(u, F.lit(s))
    return cond


def is_gallery(gallery_flag, url) -> Column:
    """The gallery flag when truthy, else the url contains the gallery path."""
    return (F.coalesce(_c(gallery_flag), F.lit(False))
            | F.contains(F.coalesce(_c(url), F.lit("")), F.lit(GALLERY_PATH)))


def is_external_link(url) -> Column:
    """The url holds none of the internal markers."""
    u = F.coalesce(_c(url), F.lit(""))
    cond = F.lit(True)
    for m in INTERNAL_MARKERS:
        cond = cond & ~F.contains(u, F.lit(m))
    return cond


def video_blob(media, post_url) -> Column:
    """struct(video_provider, video_url, audio_url) from the post's ``media`` struct.

    ``media`` has ``reddit_video: struct<fallback_url, dash_url>``, ``type`` and
    ``oembed: struct<provider_name>``.  No media -> unknown/''/''; hosted video ->
    fallback + dash url; typed embed -> provider + post url twice; else NULL.
    """
    m = _c(media)
    rv = m["reddit_video"]
    blob = lambda p, v, a: F.struct(p.alias("video_provider"), v.alias("video_url"), a.alias("audio_url"))
    return (F.when(m.isNull(), blob(F.lit("unknown"), F.lit(""), F.lit("")))
            .when(rv.isNotNull(), blob(F.lit("reddit"), F.coalesce(F.nullif(rv["fallback_url"], F.lit("")), F.lit("")),
                                       F.coalesce(F.nullif(rv["dash_url"], F.lit("")), F.lit(""))))
            .when(F.coalesce(m["type"], F.lit("")) != "", blob(m["oembed"]["provider_name"], _c(post_url), _c(post_url))))


def gallery_media(media_metadata) -> Column:
    """valid gallery entries with a body -> array<struct(id, type, url)>, url = ``u`` else ``gif``.

    ``media_metadata`` is ``map<string, struct<status, e, s: struct<u, gif>>>``.
    """
    entries = F.map_entries(_c(media_metadata))
    keep = F.filter(entries, lambda x: (x["value"]["status"] == "valid") & x["value"]["s"].isNotNull())
    return F.transform(keep, lambda x: F.struct(
        x["key"].alias("id"), x["value"]["e"].alias("type"),
        F.coalesce(F.nullif(x["value"]["s"]["u"], F.lit("")), x["value"]["s"]["gif"]).alias("url")))
