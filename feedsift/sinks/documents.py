"""Record builders and table sinks.

Builders return DataFrames shaped like the published records; the ``write_*``
helpers persist them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.operators.common import bounded_broadcast
from feedsift.sinks.named_files import register_named_text


# ---------------------------------------------------------------- K1 / S1
def write_snapshot(df: DataFrame, folder: str, run_id: str) -> None:
    """K1: overwrite the run's snapshot (one JSON folder per run id)."""
    df.write.mode("overwrite").json(f"{folder}/run_id={run_id}")


# ---------------------------------------------------------------- K2 / K12
def vector_rows(df: DataFrame, key: str, embedding: Column, *, model: str, as_of: str,
                dim: int | None = None) -> DataFrame:
    """K2: rows of the dated vector collection ``(model, as_of, item_id, embedding, error)``.

    With ``dim`` a row whose vector is missing or of another size gets an
    ``error`` (counted per row, never raised); append only the rows without one.
    """
    e = embedding.cast("array<float>")
    err = F.lit(None).cast("string")
    if dim is not None:
        err = F.when(e.isNull() | (F.size(e) != dim), F.lit("bad vector size")).otherwise(err)
    return df.select(F.lit(model).alias("model"), F.to_date(F.lit(as_of)).alias("as_of"),
                     F.col(key).cast("string").alias("item_id"), e.alias("embedding"), err.alias("error"))


def retention_keep(vectors: DataFrame, run_date: str, days: int) -> DataFrame:
    """Collections dated on or before ``run_date - days`` are dropped (partition filter)."""
    return vectors.where(F.col("as_of") > F.date_sub(F.to_date(F.lit(run_date)), days))


# ---------------------------------------------------------------- K4 / K5 / K6 / A6
def published_rows(df: DataFrame, *, name: Column, source: Column, tags: Column, k_tags: int = 3) -> DataFrame:
    """K4: common record properties; the relevant score only when truthy (not NULL, not 0)."""
    rel = F.col("relevant_score")
    return df.select("id", name.alias("name"), source.alias("source"), "list_name",
                     F.when(rel.isNotNull() & (rel != 0), rel).alias("relevant_score"),
                     F.slice(tags, 1, k_tags).alias("tags"))


def post_block_kinds(video, image, gallery, external) -> Column:
    """K5: block kinds of a post body: at most one media block (video > image > gallery > external), then text."""
    v, i, g, e = (F.col(x) if isinstance(x, str) else x for x in (video, image, gallery, external))
    media = (F.when(v, F.lit("video")).when(i, F.lit("image")).when(g, F.lit("gallery"))
             .when(e, F.lit("bookmark")))
    return F.array_compact(F.array(media, F.lit("quote"), F.lit("summary"), F.lit("permalink"), F.lit("metadata")))


def digest_sections(digest: DataFrame) -> DataFrame:
    """One section per source: heading then links in relevance order.

    The digest is already cut to its top 10 pages (F5), so each group is
    bounded by that limit.
    """
    agg = digest.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_pages"),
        F.expr("listagg(concat('- ', id), '\\n') WITHIN GROUP (ORDER BY relevant DESC, id)").alias("_links"))
    return agg.select("source", "n_pages",
                      F.concat(F.lit("## "), F.col("source"), F.lit("\n"), F.col("_links")).alias("section"))


def distinct_labels(df: DataFrame, labels: str) -> DataFrame:
    """Sorted distinct union of label arrays (explode + distinct set, bounded by distinct labels)."""
    return df.select(F.explode(labels).alias("_l")).agg(F.array_sort(F.collect_set("_l")).alias("labels"))


# ---------------------------------------------------------------- K9 / K13 / K15
# Fixed value: front-matter layout of a rendered page.
FRONT_MATTER = "---\ntitle: {title}\nsource: {source}\nrating: {rating}\n---\n{body}\n"


def markdown_files(pages: DataFrame) -> DataFrame:
    """K9: ``{source}_default_{id}.md`` with front matter and the take-aways as body."""
    content = F.format_string(FRONT_MATTER.replace("{title}", "%s").replace("{source}", "%s")
                              .replace("{rating}", "%s").replace("{body}", "%s"),
                              F.col("id"), F.col("source"), F.col("user_rating").cast("string"),
                              F.coalesce(F.col("take_aways"), F.lit("")))
    return pages.select("id", F.concat(F.col("source"), F.lit("_default_"), F.col("id"), F.lit(".md")).alias("file_name"),
                        content.alias("content"))


def write_markdown(files: DataFrame, folder: str) -> None:
    """K9: one file per row under its own name; names that exist already are skipped, and a failed job leaves nothing."""
    register_named_text(files.sparkSession)
    files.select("file_name", "content").write.format("named_text").mode("append").save(folder)


def research_sections(df: DataFrame) -> DataFrame:
    """``sections`` = Body, then References and Appendix only when non-empty."""
    sec = lambda n, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(n).alias("name"), F.col(c).alias("text")))
    body = F.struct(F.lit("Body").alias("name"), F.coalesce(F.col("body"), F.lit("")).alias("text"))
    return df.select("id", F.array_compact(F.array(body, sec("References", "refs"), sec("Appendix", "appendix"))).alias("sections"))


def checked_insert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append; a key that exists already, or twice in the new rows, fails the job (duplicate-key error)."""
    e = existing.select(*keys).distinct().withColumn("_dup", F.lit(True))
    twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_twice"))
    j = new.join(e, keys, "left").join(twice, keys, "left")
    # the check is the filter predicate itself, so the optimizer cannot prune it away
    ok = F.when(F.col("_dup").isNotNull() | F.col("_twice").isNotNull(),
                F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws("/", *[F.col(k) for k in keys])))
                .cast("boolean")).otherwise(F.lit(True))
    return j.where(ok).select(*new.columns)


# ---------------------------------------------------------------- S21 / R10
EXCLUDED_TRANSCRIPT_SITES = ["twitch.tv"]


def preferred_transcript(df: DataFrame, group: str, key: str, lang: str, prefs: list[str], *, url: Column) -> DataFrame:
    """Per group the row in the first preferred language (ties by key); excluded sites give nothing.

    ``min_by`` over (preference index, key) is a hash aggregate with map-side
    partial aggregation, so a hot group is reduced before the shuffle.
    """
    pos = F.array_position(F.array(*[F.lit(x) for x in prefs]), F.col(lang))
    blocked = F.lit(False)
    for site in EXCLUDED_TRANSCRIPT_SITES:
        blocked = blocked | F.coalesce(F.contains(url, F.lit(site)), F.lit(False))
    ok = df.where((pos > 0) & ~blocked)
    best = F.min_by(F.struct(key, lang), F.struct(pos, F.col(key))).alias("_b")
    return ok.withColumn("_pos", pos).groupBy(group).agg(best).select(group, F.col(f"_b.{key}").alias(key),
                                                                       F.col(f"_b.{lang}").alias(lang))


def late_counts(df: DataFrame, watermarks: DataFrame, key: str, ts: str, *, default_ts) -> DataFrame:
    """Per key, rows older than the watermark (never read) and rows at/after it."""
    w = bounded_broadcast(watermarks.select(F.col(key).alias("_wk"), F.col("ts").alias("_wm")))
    j = df.join(w, df[key] == w["_wk"], "left")
    bound = F.coalesce(F.col("_wm"), default_ts)
    return j.groupBy(df[key]).agg(F.count_if(F.col(ts) < bound).alias("n_late"),
                                  F.count_if(F.col(ts) >= bound).alias("n_on_time"))


def register_partitions(registry: DataFrame, new: DataFrame, key: str = "partition_id") -> DataFrame:
    """The registry with the new partition rows appended (a key already registered is not added twice)."""
    fresh = new.join(registry.select(key), key, "left_anti")
    return registry.unionByName(fresh, allowMissingColumns=True)
