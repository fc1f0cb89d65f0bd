"""User-facing jobs (C1-C12) composed from the library operators.

Each job is one lazily built set of DataFrames (the only actions while building
are the KNN joins, whose scores are checkpointed, and the checkpoints of versioned
refinement): Spark plans the whole chain, so scans are pruned once and the only shuffles are the dedup
joins, the KNN block exchange and the per-key aggregations.  Every job returns
its published rows and its per-stage funnel so a caller can write both in one
pass (e.g. inside ``foreachBatch``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedsift.functions import labels as L
from feedsift.functions import text as X
from feedsift.operators import dedup as D
from feedsift.operators import enrich as EN
from feedsift.operators import filters as FL
from feedsift.operators import knn
from feedsift.operators import state as S
from feedsift.operators import stats as ST
from feedsift.operators.common import spread
from feedsift.operators.embed import hashing_embedding
from feedsift.operators.summarise import CentralSentences, KeySentences
from feedsift.session import cut_lineage
from feedsift.settings import DEFAULT, Settings
from feedsift.sinks import documents as DOC
from feedsift.sinks import records as R
from feedsift.sinks.publish import publish_observed
from feedsift.sources import normalise as N
from feedsift.sources import scans as SC
from feedsift.sources.transcripts import resolve_transcripts


@dataclass
class JobOutput:
    """``stages`` has a row per input item (key columns, the published columns, and the stage columns behind ``flags``)."""

    published: DataFrame
    funnel: DataFrame
    stages: DataFrame | None = None
    flags: dict[str, Column] | None = None
    cache: DataFrame | None = None                 # rows to add to a read-through cache
    rates: DataFrame | None = None                 # histogram of the published rates (A4)

    def publish(self, path: str, groups: list[str], *, rejected: Column | None = None) -> dict:
        """K3/A3: write the published rows and count all stages of ``groups`` in one action."""
        return publish_observed(self.stages, path, by="list_name", groups=groups, flags=self.flags, published=F.col("_pub"),
                                columns=self.published.columns, rejected=rejected)


def _staged(flagged: DataFrame, scored: DataFrame, published: DataFrame, keys: list[str], flags: dict[str, Column]) -> JobOutput:
    """The stage table of a job: every input item, whether it had been visited, its score, and what was published of it."""
    base = flagged.select(*keys, "is_visited").join(scored.select(*keys, F.lit(True).alias("_scored")), keys, "left")
    stages = base.join(published.withColumn("_pub", F.lit(True)), keys, "left").withColumn("_pub", F.coalesce("_pub", F.lit(False))) \
        .withColumn("_scored", F.coalesce("_scored", F.lit(False)))
    return JobOutput(published, ST.funnel_counts(stages, ["list_name"], flags), stages, flags)


def _stage_flags(ranked: Column | None = None) -> dict[str, Column]:
    """The seven counters over a stage table; ``ranked`` says which published rows the classifier has seen."""
    fresh, pub = ~F.col("is_visited"), F.col("_pub")
    return {"total_input": F.lit(True), "post_deduping": fresh, "post_scoring": fresh & F.col("_scored"), "post_filtering": pub,
            "post_summary": pub, "post_ranking": F.lit(False) if ranked is None else pub & F.coalesce(ranked, F.lit(False)), "total_pushed": pub}


def score_items(items: DataFrame, score_text: Column, rated_vectors: DataFrame, rated_meta: DataFrame, *,
                settings: Settings = DEFAULT, k: int | None = None, self_exclude: bool = False, vectors: DataFrame | None = None) -> DataFrame:
    """A2: score text -> embedding -> k nearest rated vectors -> mean rating (-1 when none).

    ``vectors`` has the same items with their embedding in ``_vector``, where it has been made before.

    An item is known by its id within its list, where there are lists: one id in
    two lists is scored in each. The scores (a key and a number each) are checkpointed, so that
    the search runs once however many branches of a job read them, and never in one task with their models.
    """
    keyed = "list_name" in items.columns
    key = F.to_json(F.struct("list_name", "id")) if keyed else F.col("id")
    items = items.withColumn("_query", key)
    if vectors is None:
        q = spread(items.select(F.col("_query").alias("query_id"), score_text.alias("_t"))) \
            .select("query_id", hashing_embedding(F.col("_t")).alias("embedding"))
    else:
        q = vectors.select(key.alias("query_id"), F.col("_vector").alias("embedding"))
    scores = knn.relevance_score(q, rated_vectors, rated_meta, k or settings.neighbours, settings.metric,
                                 settings.max_distance, unknown=settings.unknown_score, self_exclude=self_exclude)
    scores = cut_lineage(scores.select(F.col("query_id").alias("_query"), "relevant_score"))
    return items.join(scores, "_query", "left").drop("_query")


def rated_vectors_of(pages: DataFrame, text: Column) -> DataFrame:
    """C6 (index side): rated pages -> ``(item_id, embedding)`` of their text."""
    return spread(pages.select(F.col("id").alias("item_id"), text.alias("_t"))) \
        .select("item_id", hashing_embedding(F.col("_t")).alias("embedding"))


def curate(items: DataFrame, visited: DataFrame, rated_vectors: DataFrame, rated_meta: DataFrame, *,
           overrides: DataFrame | None = None, model: EN.TextModel | None = None,
           settings: Settings = DEFAULT) -> JobOutput:
    """C1/X1 (items whose texts are ready): dedup -> score -> per-list threshold -> gate/classify -> top labels -> publish.

    ``items``: ``id, list_name, title, body``.  Returns published rows and the
    seven-stage funnel per list, computed from stage flags in one aggregation.
    Texts are embedded, and read by a model with a table, where they are stored: the joins with the visited set and the scores
    move vectors, keys and titles, and no bodies.
    """
    def new(flagged: DataFrame) -> DataFrame:
        return flagged.where(~F.col("is_visited")).drop("is_visited")

    on = {"id": "item_id", "list_name": "list_name"}
    flagged = D.visited_flags(items.withColumn("_text_key", EN.text_key(F.col("body"))), visited, on)
    score_text = X.score_text_post(F.col("list_name"), F.col("title"), F.col("body"))
    vectors = spread(items.select("id", "list_name", score_text.alias("_t"))).select("id", "list_name", hashing_embedding(F.col("_t")).alias("_vector"))
    scored = score_items(new(flagged), score_text, rated_vectors, rated_meta, settings=settings, vectors=new(D.visited_flags(vectors, visited, on)))
    ovr = overrides if overrides is not None else items.sparkSession.createDataFrame([], "list_name STRING, min_score DOUBLE")
    with_min = FL.with_list_min(scored, ovr, default=settings.min_score)
    passed = with_min.where(FL.passes_min(F.col("relevant_score"), F.col("min_score"))).drop("min_score")
    ranked = EN.classify_rank(passed, "id", "relevant_score", X.rank_text_post(F.col("title"), F.col("body")),
                              model or EN.RankModel(), short_post=True, model_text=F.col("body"), texts=items, model_key="_text_key", settings=settings)
    published = ranked.select("id", "list_name", "title", "relevant_score", "rate", "feedback",
                              L.topk_labels(F.transform("topics", lambda t: F.struct(
                                  X.label_normalise(t["name"]).alias("name"), t["score"].alias("score"))),
                                  settings.top_labels).alias("topics"),
                              L.topk_labels(F.transform("categories", lambda t: F.struct(
                                  X.label_normalise(t["name"]).alias("name"), t["score"].alias("score"))),
                                  settings.top_labels).alias("categories"),
                              "ranked")
    return _staged(flagged, scored, published, ["list_name", "id"], _stage_flags(F.col("ranked")))


def short_posts(raw: DataFrame, visited: DataFrame, rated_vectors: DataFrame, rated_meta: DataFrame, *, model: EN.TextModel,
                overrides: DataFrame | None = None, settings: Settings = DEFAULT) -> JobOutput:
    """C1 (short posts): replies looked up -> dedup -> score of reply and post text (P6) -> per-list threshold ->
    gate/classify -> top labels -> publish.

    ``raw``: ``list_name, id, name, text, reply_to`` (the id of the post it answers, in the same list).
    """
    looked_up = R.reply_enrich(raw, raw.withColumnRenamed("id", "post_id"), ["list_name"], "reply_to", "post_id")
    items = looked_up.withColumn("body", X.score_text_short(F.col("reply_name"), F.col("reply_text"), F.col("name"), F.col("text")))
    flagged = D.visited_flags(items.withColumn("_text_key", EN.text_key(F.col("body"))), visited, {"id": "item_id", "list_name": "list_name"})
    fresh = flagged.where(~F.col("is_visited")).drop("is_visited")
    scored = score_items(fresh, F.col("body"), rated_vectors, rated_meta, settings=settings)
    ovr = overrides if overrides is not None else raw.sparkSession.createDataFrame([], "list_name STRING, min_score DOUBLE")
    with_min = FL.with_list_min(scored, ovr, default=settings.min_score)
    passed = with_min.where(FL.passes_min(F.col("relevant_score"), F.col("min_score"))).drop("min_score")
    ranked = EN.classify_rank(passed.withColumn("_key", F.to_json(F.struct("list_name", "id"))), "_key", "relevant_score", F.col("body"), model, short_post=True, model_key="_text_key",
                              settings=settings)
    published = ranked.select("id", "list_name", "name", "reply_deleted", "relevant_score", "rate", "feedback", L.topk_labels("topics", settings.top_labels).alias("topics"), "ranked")
    return _staged(flagged, scored, published, ["list_name", "id"], _stage_flags(F.col("ranked")))


def _summarised(df: DataFrame, key: str, text: str, primary: EN.TextModel | None, fallback: EN.TextModel | None, settings: Settings) -> DataFrame:
    """M3/M6: ``df`` with ``summary`` (map-reduce; the fallback model reads the whole text where the primary one has no answer) and ``used``."""
    primary, fallback = primary or CentralSentences(answer_unlinked=False), fallback or KeySentences()
    summ = EN.mapreduce_summary(df, key, text, primary, primary, size=settings.summary_chunk, overlap=settings.summary_overlap)
    unanswered = F.col("summary") == ""
    again = EN.model_call(fallback, F.when(unanswered, F.col(text)))          # an empty text where there is an answer
    return summ.withColumn("_again", again).withColumn("used", F.when(unanswered, fallback.name).otherwise(primary.name)) \
        .withColumn("summary", F.when(unanswered, F.coalesce("_again", F.lit(""))).otherwise(F.col("summary"))).drop("_again")


def posts(raw: DataFrame, visited: DataFrame, rated_vectors: DataFrame, rated_meta: DataFrame, summaries: DataFrame, *,
          overrides: DataFrame | None = None, model: EN.TextModel | None = None, primary: EN.TextModel | None = None,
          fallback: EN.TextModel | None = None, settings: Settings = DEFAULT) -> JobOutput:
    """C5 (posts): normalise (S10) -> dedup -> score (P7) -> per-list threshold -> summary gate and map-reduce summary (F12, M3,
    M6) -> gate/classify -> body blocks (K5) -> publish, with the histogram of the rates (A4).

    ``raw``: the stored posts as JSON; a post's list is its subreddit. ``summaries`` (``item_id, value``) holds valid cached
    summaries; ``cache`` of the result the new ones. What passes the threshold is checkpointed, so that scoring runs once
    however many branches read it.
    """
    items = N.normalise_posts(raw).withColumn("list_name", F.col("subreddit"))
    items = items.withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "text")})
    flagged = D.visited_flags(items, visited, {"id": "item_id", "list_name": "list_name"})
    fresh = flagged.where(~F.col("is_visited")).drop("is_visited")
    scored = score_items(fresh, X.score_text_post(F.col("list_name"), F.col("title"), F.col("text")), rated_vectors, rated_meta, settings=settings)
    ovr = overrides if overrides is not None else raw.sparkSession.createDataFrame([], "list_name STRING, min_score DOUBLE")
    with_min = FL.with_list_min(scored, ovr, default=settings.min_score)
    passed = with_min.where(FL.passes_min(F.col("relevant_score"), F.col("min_score"))).drop("min_score")
    kept = summaries.where(F.col("value") != "").groupBy("item_id").agg(F.max("value").alias("_kept"))
    passed = passed.join(kept, passed["id"] == kept["item_id"], "left").drop("item_id")
    passed = cut_lineage(passed.withColumn("_action", FL.summary_action(F.col("text"), F.col("_kept").isNotNull(), settings)).where("_action <> 'drop'"))
    done = _summarised(passed.where("_action = 'summarise'"), "id", "text", primary, fallback, settings)
    rest = passed.where("_action <> 'summarise'").withColumn("summary", F.coalesce("_kept", F.lit(""))).withColumn("used", F.col("_action"))
    ranked = EN.classify_rank(done.unionByName(rest), "id", "relevant_score", X.rank_text_post(F.col("title"), F.col("text")),
                              model or EN.RankModel(), short_post=True, model_text=F.col("text"), texts=passed, settings=settings)
    published = ranked.select("id", "list_name", "title", "permalink", "relevant_score", "summary", "used", "rate", "feedback",
                              L.topk_labels("topics", settings.top_labels).alias("topics"), "ranked",
                              DOC.post_block_kinds("is_video", "is_image", "is_gallery", "is_external_link").alias("blocks"))
    out = _staged(flagged, fresh, published, ["list_name", "id"], _stage_flags(F.col("ranked")))
    out.cache = done.where(F.col("summary") != "").select(F.col("id").alias("item_id"), F.col("summary").alias("value"))
    out.rates = ST.rate_histogram(published, ["list_name"])
    return out


def feeds(entries: DataFrame, visited: DataFrame, rated_vectors: DataFrame, rated_meta: DataFrame, *,
          settings: Settings = DEFAULT) -> JobOutput:
    """C4 (feeds): first 3 per feed -> dedup -> score -> global top-k (k=1) -> map-reduce summary -> first tags."""
    head = SC.head_per_group(entries, "list_name", [F.col("pos")], 3)
    flagged = D.visited_flags(head, visited, {"id": "item_id", "list_name": "list_name"})
    fresh = flagged.where(~F.col("is_visited")).drop("is_visited")
    scored = score_items(fresh, X.score_text_feed(F.col("title"), F.col("list_name"), F.col("body")),
                         rated_vectors, rated_meta, settings=settings)
    top = FL.relevance_topk(scored, "relevant_score", "id", k=settings.relevance_top_k, min_score=settings.min_score)
    summ = EN.mapreduce_summary(top.withColumn("_item", F.to_json(F.struct("list_name", "id"))), "_item", "body", CentralSentences(), CentralSentences(),
                                size=settings.summary_chunk, overlap=settings.summary_overlap)
    published = summ.select("id", "list_name", "title", "relevant_score", "summary",
                            L.firstk(F.split("title", " "), settings.top_labels).alias("tags"))
    return _staged(flagged, scored, published, ["list_name", "id"], _stage_flags())


def articles(inbox: DataFrame, watermarks: DataFrame, visited: DataFrame, *, run_ts: Column,
             model: EN.TextModel | None = None, settings: Settings = DEFAULT) -> JobOutput:
    """C2 (articles): inbox since watermark -> dedup -> map-reduce summary -> classify -> published rows.

    The caller advances the watermarks from the published rows (``state.advance_watermarks``) after writing them.
    """
    pulled = S.since_watermark(inbox, watermarks, "source", "created_time", strict=False,
                               default_ts=run_ts - F.expr("INTERVAL 1 DAY"))
    flagged = D.visited_flags(pulled.withColumn("list_name", F.col("source")), visited, {"id": "item_id"})
    fresh = flagged.where(~F.col("is_visited")).drop("is_visited")
    summ = EN.mapreduce_summary(fresh, "id", "content", CentralSentences(), CentralSentences(),
                                size=settings.summary_chunk, overlap=settings.summary_overlap)
    model = model or EN.RankModel()
    ranked = EN.classify_rank(EN.stored_for(model, summ.drop("content")).withColumn("relevant_score", F.lit(None).cast("double")), "id", "relevant_score",
                              F.col("summary"), model, settings=settings)
    published = ranked.select("id", "list_name", "source", "title", "summary", "rate", "feedback",
                              L.topk_labels("topics", settings.top_labels).alias("topics"), "ranked")
    return _staged(flagged, fresh, published, ["list_name", "id"], _stage_flags(F.col("ranked")))


def videos(inbox: DataFrame, watermarks: DataFrame, tracks: DataFrame, transcripts: DataFrame, *, run_ts: Column, langs: list[str],
           visited: DataFrame | None = None, model: EN.TextModel | None = None, primary: EN.TextModel | None = None,
           fallback: EN.TextModel | None = None, settings: Settings = DEFAULT) -> JobOutput:
    """C3 (videos): inbox since watermark -> dedup (if ``visited`` is given) -> transcript (S21) -> map-reduce summary, by the
    fallback model where the primary one has no answer (M6) -> classify -> published rows.

    ``inbox``: ``id, source, title, url, created_time``; ``tracks`` and ``transcripts`` (the cache) as in
    ``resolve_transcripts``. A video without a transcript isn't published. ``cache`` of the result has the transcripts to keep.
    """
    pulled = S.since_watermark(inbox, watermarks, "source", "created_time", strict=False, default_ts=run_ts - F.expr("INTERVAL 1 DAY"))
    pulled = pulled.withColumn("list_name", F.col("source"))
    flagged = pulled.withColumn("is_visited", F.lit(False)) if visited is None else D.visited_flags(pulled, visited, {"id": "item_id"})
    fresh = flagged.where(~F.col("is_visited")).drop("is_visited")
    heard, cache = resolve_transcripts(fresh, tracks, transcripts, langs, now=run_ts, ttl_seconds=settings.model_cache_ttl)
    summ = _summarised(heard.where(F.col("transcript") != ""), "id", "transcript", primary, fallback, settings)
    model = model or EN.RankModel()
    ranked = EN.classify_rank(EN.stored_for(model, summ.drop("transcript")).withColumn("relevant_score", F.lit(None).cast("double")), "id", "relevant_score",
                              F.col("summary"), model, settings=settings)
    published = ranked.select("id", "list_name", "source", "title", "via", "summary", "used", "rate", "feedback",
                              L.topk_labels("topics", settings.top_labels).alias("topics"), "ranked")
    out = _staged(flagged, fresh, published, ["list_name", "id"], _stage_flags(F.col("ranked")))
    out.cache = cache
    return out


def sync_and_index(rated_pages: DataFrame, visited: DataFrame, page_state: DataFrame, *, run_date: str,
                   settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Latest rated version per page -> new/changed split -> metadata upsert -> vector rows of new pages.

    Retention of old collections is its own job (``retention``, C11).
    """
    latest = SC.sync_rated(rated_pages)
    latest = latest.withColumn("user_rating", F.col("user_rating").cast("int"))
    split = D.rating_change_split(latest.withColumnRenamed("id", "page_id"), visited, page_state)
    updated = split.where(F.col("is_updated"))
    new_state = S.upsert(page_state, updated.select("page_id", "user_rating"), "page_id", overwrite=True,
                         ttl_seconds=settings.rating_ttl, now=F.current_timestamp())
    vectors = DOC.vector_rows(split.where(F.col("is_new")), "page_id",
                              hashing_embedding(F.coalesce(F.col("take_aways"), F.lit(""))),
                              model="hashing", as_of=run_date)
    return {"latest": latest, "page_state": new_state, "vectors": vectors}


def weekly_digest(rated_pages: DataFrame, rated_vectors: DataFrame, rated_meta: DataFrame, *, page_texts: DataFrame | None = None,
                  now: Column | None = None, period: str = "weekly", settings: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Look-back -> pre-filter -> score against the collection (k=4, self excluded) -> post-filter -> sections, labels.

    With ``now`` only pages edited within the ``period`` before it are read;
    ``page_texts`` (``id, page_text``) holds the text of the pages' blocks, which
    the score text contains.
    """
    if now is not None:
        rated_pages = rated_pages.where(F.col("last_edited_time") >= FL.period_start(now, period))
    pages = FL.digest_prefilter(SC.sync_rated(rated_pages))
    if page_texts is None:
        pages = pages.withColumn("page_text", F.lit(""))
    else:
        pages = pages.join(page_texts.select("id", "page_text"), "id", "left")
    scored = score_items(pages, X.score_text_digest(F.col("id"), F.col("page_text"), F.col("take_aways")),
                         rated_vectors, rated_meta, settings=settings, k=settings.digest_neighbours, self_exclude=True)
    digest = FL.digest_postfilter(scored.withColumn("user_rating", F.col("user_rating").cast("int"))
                                  .withColumn("relevant", F.col("relevant_score")), settings=settings)
    return {"digest": digest, "sections": DOC.digest_sections(digest),
            "labels": DOC.distinct_labels(digest.select(F.concat("tags", F.array("source")).alias("l")), "l"),
            "takeaways": FL.takeaway_pages(digest)}


def daily_journal(notes: DataFrame, watermarks: DataFrame, *, run_ts: Column, model: EN.TextModel | None = None) -> dict[str, DataFrame]:
    """Notes after the watermark (strict) -> six model passes over each day's text, which streams by -> record blocks -> watermark."""
    pulled = S.since_watermark(notes, watermarks, "source", "created_time", strict=True,
                               default_ts=run_ts - F.expr("INTERVAL 365 DAYS"))
    rolled = R.journal_rollup(pulled)
    refined = R.journal_refined(pulled, model or EN.DigestModel("S:"))
    from feedsift.operators.chunking import pack_sentences

    blocks = rolled.select("day", F.posexplode(pack_sentences("text", 1800)).alias("block_no", "block"))
    wm = S.advance_watermarks(watermarks, pulled, "source", "created_time")
    return {"refined": refined, "blocks": blocks, "watermarks": wm}


def todo_actions(pages: DataFrame, todo_state: DataFrame, *, excluded_sources=None) -> DataFrame:
    """Changed since processed -> exclusions -> take-aways -> action list model -> action rows."""
    changed = D.changed_since_processed(pages, todo_state, "id", "last_edited_time")
    kept = FL.takeaway_pages(FL.exclude_source_tag(changed, sources=excluded_sources))
    gen = R.todo_generate(kept, "id", "take_aways", R.ActionListModel(), R.ActionListModel(prefix="tr|", header="T"))
    return R.todo_rows(gen, "id", "todo", "todo_trans")


def research(pages: DataFrame, acted: DataFrame, topics_docs: DataFrame, *, rounds: int = 3) -> dict[str, DataFrame]:
    """Never acted on -> deep-dive tag -> evidence -> versioned refinement -> record sections."""
    fresh = D.anti_join_visited(pages, acted, {"id": "id"})
    chosen = FL.include_tag(FL.takeaway_pages(fresh))
    versions = EN.refine_versions(chosen, "id", "take_aways", EN.DigestModel("S:"), rounds=rounds)
    current = versions.where("is_current").select("id", F.col("text").alias("body"))
    topics = chosen.select(F.col("id").alias("item_id"), F.col("take_aways").alias("text"))
    ev = R.collect_evidence(topics, topics_docs, EN.DigestModel("S:"))
    refs = R.reference_list(ev.withColumn("title", F.substring("text", 1, 30))
                            .withColumn("url", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))), "item_id", "rnk")
    record = current.join(refs.select(F.col("item_id").alias("id"), "refs"), "id", "left") \
        .withColumn("appendix", F.lit(""))
    return {"versions": versions, "record": DOC.research_sections(record)}


def retention(vectors: DataFrame, run_date: str, settings: Settings = DEFAULT) -> DataFrame:
    """C11: keep only collections newer than run date - 3 days."""
    return DOC.retention_keep(vectors, run_date, settings.retention_days)


def markdown_archive(pages: DataFrame, visited: DataFrame) -> DataFrame:
    """Not yet archived -> rating floor -> markdown files."""
    fresh = D.anti_join_visited(pages, visited, {"id": "item_id"})
    return DOC.markdown_files(fresh.where(F.col("user_rating").cast("int") >= 4))


def run_sources(actions: dict[str, Callable[[], object]]) -> dict[str, dict]:
    """Run each source's action (a write, a count) on its own; a failing source is recorded and skipped.

    The reference turns a failing source into an empty batch and goes on; here
    each source's Spark action runs inside its own ``try`` so one source's
    failure never stops the others.  Per-row failures are handled inside the
    plans (``error`` columns), never by exceptions.
    """
    out: dict[str, dict] = {}
    for name, act in actions.items():
        try:
            out[name] = {"ok": True, "result": act(), "error": None}
        except Exception as e:  # noqa: BLE001 - isolation is the point
            out[name] = {"ok": False, "result": None, "error": f"{type(e).__name__}: {e}"[:500]}
    return out
