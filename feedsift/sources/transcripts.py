"""Transcripts of videos: cached ones first, then the tracks in the first preferred language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.sinks.documents import EXCLUDED_TRANSCRIPT_SITES


def on_excluded_site(url: Column) -> Column:
    hit = F.lit(False)
    for site in EXCLUDED_TRANSCRIPT_SITES:
        hit = hit | F.coalesce(F.contains(url, F.lit(site)), F.lit(False))
    return hit


def resolve_transcripts(videos: DataFrame, tracks: DataFrame, cache: DataFrame, langs: list[str], *, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """``videos`` (``id, url, ...``) with ``transcript`` and ``via``, and the new rows of ``cache``.

    ``via`` is ``excluded`` (a site whose videos are never read: empty transcript), ``cache`` (a valid cached text that isn't
    empty), the language of the tracks used, or ``none``. ``tracks`` holds ``video_id, lang, part, text``; the parts of the
    chosen language follow in order, each ended by a line feed. A cached row is ``item_id, value, expires_at``; what was
    looked up, even in vain, is a new one.

    The language is chosen by a small aggregate before any text is moved, and only texts of that language, of videos that
    need them, are shuffled and joined up; a group is one video's transcript.
    """
    valid = cache.where((F.col("expires_at") > now) & (F.col("value") != "")).groupBy("item_id").agg(F.max("value").alias("_cached"))
    known = videos.join(valid, videos["id"] == valid["item_id"], "left").drop("item_id").withColumn("_barred", on_excluded_site(F.col("url")))
    wanted = known.where(~F.col("_barred") & F.col("_cached").isNull()).select(F.col("id").alias("video_id"))
    place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang"))
    usable = tracks.withColumn("_place", place).where("_place > 0").join(wanted.distinct(), "video_id", "left_semi")
    first = usable.groupBy("video_id").agg(F.min("_place").alias("_place"))
    part = F.struct("part", F.coalesce("text", F.lit("")).alias("text"))
    spoken = usable.join(first, ["video_id", "_place"]).groupBy("video_id").agg(F.first("lang").alias("_lang"), F.array_sort(F.collect_list(part)).alias("_parts"))
    spoken = spoken.select("video_id", "_lang", F.array_join(F.transform("_parts", lambda p: F.concat(p["text"], F.lit("\n"))), "").alias("_spoken"))
    found = known.join(spoken, known["id"] == spoken["video_id"], "left")
    via = F.when(F.col("_barred"), "excluded").when(F.col("_cached").isNotNull(), "cache").otherwise(F.coalesce("_lang", F.lit("none")))
    text = F.when(F.col("_barred"), "").otherwise(F.coalesce("_cached", "_spoken", F.lit("")))
    resolved = found.select(*videos.columns, text.alias("transcript"), via.alias("via"))
    expires = now + F.make_dt_interval(secs=F.lit(ttl_seconds))
    new = resolved.where(~F.col("via").isin("excluded", "cache")).groupBy(F.col("id").alias("item_id")).agg(F.first("transcript").alias("value")).withColumn("expires_at", expires)
    return resolved, new
