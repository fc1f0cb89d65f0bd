"""Composite jobs: internal consistency of published rows and funnels."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedsift.catalog import QUERIES, load_all
from tests.conftest import SMALL

load_all()


def test_curate_published_subset_and_funnel(spark):
    pub = QUERIES["curate_posts"](spark, SMALL)
    funnel = {(r.list_name, r.stage): r.n for r in QUERIES["curate_funnel"](spark, SMALL).collect()}
    items = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert pub.join(items, pub["id"] == items["doc_id"], "left_anti").count() == 0
    per_list = {r.source: r["count"] for r in items.groupBy("source").count().collect()}
    for lst, n in per_list.items():
        assert funnel[(lst, "total_input")] == n
        assert funnel[(lst, "post_deduping")] <= n
    assert sum(v for (l, s), v in funnel.items() if s == "total_pushed") == pub.count()
    # published scores pass their threshold or are unknown
    bad = pub.where((F.col("relevant_score") >= 0) & (F.col("relevant_score") < 3)).count()
    assert bad == 0


def test_scores_are_searched_once_for_all_branches_of_a_job(spark):
    """The published rows and the stage table read stored scores; no branch embeds texts or searches again."""
    from feedsift.operators import enrich as EN
    from feedsift.plans import jobs as J

    def table(name):
        return spark.createDataFrame([(i, f"l{i % 2}", f"title {i}", f"body {i} word{i % 5}") for i in range(12)], f"{name} long, list_name string, title string, body string")

    items = table("id")
    visited = table("item_id").where("item_id % 4 = 0").select("item_id", "list_name")
    vectors = J.rated_vectors_of(table("id").where("id < 6").select("id", "body"), F.col("body"))
    meta = table("item_id").where("item_id < 6").select("item_id", F.lit(5).alias("user_rating"))
    posts = table("id").select("list_name", "id", F.lit("n").alias("name"), F.col("body").alias("text"), F.lit(None).cast("long").alias("reply_to"))
    for out in (J.curate(items, visited, vectors, meta), J.short_posts(posts, visited, vectors, meta, model=EN.RankModel())):
        for df in (out.stages, out.published, out.funnel):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert not any(step in plan for step in ("MapInPandas", "FlatMapCoGroups", "embed("))
        assert out.stages.where("NOT is_visited AND _scored").count() == 9


def test_curating_joins_keys_and_vectors_but_no_bodies(spark, monkeypatch):
    """With a classifier that has a table, no join of the job gives out a body: not for the search, and not for what is published."""
    from feedsift.operators import classify
    from feedsift.plans import jobs as J

    items = spark.createDataFrame([(i, f"l{i % 2}", f"title {i}", f"body {i} word{i % 5}") for i in range(12)], "id long, list_name string, title string, body string")
    labels = ["topic", "category", "quality"]
    trained = items.select("id", "body", *[(F.col("id") % 2).cast("string").alias(c) for c in labels])
    visited = items.where("id % 4 = 0").select(F.col("id").alias("item_id"), "list_name")
    meta = items.select(F.col("id").alias("item_id"), F.lit(5).alias("user_rating"))
    model = classify.RankClassifier(classify.fit(trained, "id", "body", labels, held=2))
    asked, score = [], J.knn.relevance_score
    monkeypatch.setattr(J.knn, "relevance_score", lambda q, *a, **kw: asked.append(q) or score(q, *a, **kw))
    out = J.curate(items, visited, J.rated_vectors_of(items, F.col("body")), meta, model=model)

    def joins(plan):
        below, found = plan.children(), [plan.output().mkString(" ")] if plan.nodeName() == "Join" else []
        return found + [x for i in range(below.size()) for x in joins(below.apply(i))]

    for df in (*asked, out.published, out.stages):
        found = joins(df._jdf.queryExecution().optimizedPlan())
        assert found and not any("body#" in x for x in found)
    assert out.published.count() == 9 and {r.ranked for r in out.published.collect()} == {True}


def test_feed_publishes_at_most_one(spark):
    assert QUERIES["curate_feed"](spark, SMALL).count() <= 1


def test_jobs_run(spark):
    for q in ["weekly_digest", "daily_journal", "todo_actions", "sync_and_index"]:
        assert QUERIES[q](spark, SMALL).count() >= 0


def test_failing_source_is_isolated(spark):
    from feedsift.plans.jobs import run_sources

    good = lambda: spark.read.parquet(f"{SMALL}/documents.parquet").count()
    bad = lambda: spark.read.parquet(f"{SMALL}/missing.parquet").count()
    res = run_sources({"documents": good, "broken": bad, "again": good})
    assert res["documents"]["ok"] and res["again"]["ok"] and not res["broken"]["ok"]
    assert res["documents"]["result"] == res["again"]["result"] > 0


def test_publishing_counts_what_the_funnel_counts(spark, tmp_path):
    from feedsift.catalog.q_jobs import _short_posts

    out = _short_posts(spark, SMALL)
    groups = ["tech", "news", "unused"]
    rejected = F.when(F.col("id") % 5 == 0, "refused")
    seen = out.publish(str(tmp_path / "published"), groups, rejected=rejected)
    assert {(r.list_name, r.stage, r.n) for r in out.funnel.collect()} == {x for x in seen["funnel"] if x[0] != "unused"}
    assert {n for g, _, n in seen["funnel"] if g == "unused"} == {0}
    written = spark.read.parquet(str(tmp_path / "published"))
    pushed = out.published.count()
    assert sum(t["attempts"] for t in seen["tallies"].values()) == pushed > 0
    assert written.count() == pushed - sum(t["error"] for t in seen["tallies"].values()) and written.where("id % 5 = 0").count() == 0
    assert written.columns == out.published.columns


def test_transcripts_of_every_kind(spark):
    from feedsift.sources.transcripts import resolve_transcripts

    videos = spark.createDataFrame([(1, "https://a/1"), (2, "https://a/2"), (3, "https://m.twitch.tv/x"), (4, None), (5, "https://a/5"), (6, "https://a/6"), (6, "https://a/6")],
                                   "id long, url string")
    tracks = spark.createDataFrame([(1, "de", 0, "nein"), (1, "fr", 2, "b"), (1, "fr", 1, "a"), (1, "fr", None, None), (2, "en", 0, "not read"), (3, "en", 0, "barred"),
                                    (4, "en", 0, "one"), (4, "fr", 0, "zwei"), (5, "de", 0, "nein"), (6, "en", 1, "same"), (None, "en", 0, "lost")],
                                   "video_id long, lang string, part int, text string")
    cache = spark.sql("""SELECT * FROM VALUES (2L, 'kept', TIMESTAMP'2030-01-01'), (1L, '', TIMESTAMP'2030-01-01'), (4L, 'old', TIMESTAMP'2020-01-01'), (3L, 'barred', TIMESTAMP'2030-01-01'),
                         (2L, 'a', TIMESTAMP'2030-01-01') AS t(item_id, value, expires_at)""")
    got, new = resolve_transcripts(videos, tracks, cache, ["en", "fr"], now=F.lit("2024-01-01").cast("timestamp"), ttl_seconds=60)
    assert {(r.id, r.via, r.transcript) for r in got.collect()} == {(1, "fr", "\na\nb\n"), (2, "cache", "kept"), (3, "excluded", ""), (4, "en", "one\n"), (5, "none", ""), (6, "en", "same\n")}
    assert got.count() == 7 and got.columns == ["id", "url", "transcript", "via"]
    assert sorted((r.item_id, r.value, str(r.expires_at)) for r in new.collect()) == [(i, t, "2024-01-01 00:01:00") for i, t in ((1, "\na\nb\n"), (4, "one\n"), (5, ""), (6, "same\n"))]
    empty, none = resolve_transcripts(videos.limit(0), tracks, cache.limit(0), ["en"], now=F.current_timestamp(), ttl_seconds=1)
    assert empty.count() == none.count() == 0


def test_a_video_without_an_answer_goes_to_the_fallback(spark):
    from feedsift.plans import jobs as J

    class Silent:
        name = "silent"

        def generate(self, texts):
            return [""] * len(texts)

    inbox = spark.sql("SELECT id, 's' AS source, 't' AS title, 'u' AS url, TIMESTAMP'2024-01-01' AS created_time FROM VALUES (1L), (2L), (3L) AS t(id)")
    tracks = spark.createDataFrame([(1, "en", 0, "One sentence. And another one."), (2, "de", 0, "nein")], "video_id long, lang string, part int, text string")
    marks, cache = spark.createDataFrame([], "source string, ts timestamp"), spark.createDataFrame([], "item_id long, value string, expires_at timestamp")
    seen = spark.createDataFrame([(3,)], "item_id long")
    for visited, deduped in ((None, 3), (seen, 2)):
        out = J.videos(inbox, marks, tracks, cache, run_ts=F.lit("2024-01-01 10:00:00").cast("timestamp"), langs=["en"], visited=visited, primary=Silent())
        assert [(r.id, r.used, r.summary) for r in out.published.collect()] == [(1, "key-sentences", "One sentence. And another one.")]
        counts = {r.stage: r.n for r in out.funnel.collect()}
        assert counts["total_input"] == 3 and counts["post_deduping"] == deduped and counts["total_pushed"] == 1
        assert {r.item_id for r in out.cache.collect()} == {1, 2, 3} - ({3} if visited is not None else set())


def test_posts_reuse_cached_summaries_and_drop_empty_texts(spark):
    from feedsift.plans import jobs as J
    from feedsift.sources.normalise import normalise_posts

    rows = [("a", "first", "One sentence here. And another one here."), ("a", "second", ""), ("b", "third", None), ("b", "fourth", "Read before."), ("b", "fifth", "Kept. Kept too."), ("b", "sixth", "...")]
    raw = spark.createDataFrame([(s, t, x, 1_700_000_000.0 + i) for i, (s, t, x) in enumerate(rows)], "subreddit string, title string, selftext string, created_utc double")
    raw = raw.select(F.to_json(F.struct(F.struct("subreddit", "title", "selftext", "created_utc", F.lit("https://arxiv.org/x").alias("url"), F.lit("/r/x").alias("permalink")).alias("data"))).alias("raw"))
    ids = {r.title: r.id for r in normalise_posts(raw).collect()}
    seen = spark.createDataFrame([(ids["fourth"], "b"), (ids["first"], "b")], "item_id string, list_name string")
    kept = spark.createDataFrame([(ids["fifth"], "from the cache"), (ids["first"], "")], "item_id string, value string")
    vectors = spark.createDataFrame([], "item_id string, embedding array<double>")
    out = J.posts(raw, seen, vectors, spark.createDataFrame([], "item_id string, user_rating int"), kept)
    got = {r.title: (r.summary, r.used, r.relevant_score, r.blocks) for r in out.published.collect()}
    blocks = ["bookmark", "quote", "summary", "permalink", "metadata"]
    assert got == {"first": ("One sentence here. And another one here.", "central-sentences", -1.0, blocks), "fifth": ("from the cache", "cached", -1.0, blocks), "sixth": ("", "key-sentences", -1.0, blocks)}
    assert {(r.item_id, r.value) for r in out.cache.collect()} == {(ids["first"], got["first"][0])}
    n = {(r.list_name, r.stage): r.n for r in out.funnel.collect()}
    assert n["a", "total_input"] == 2 and n["b", "total_input"] == 4 and n["b", "post_deduping"] == 3 and n["b", "total_pushed"] == 2 and n["a", "total_pushed"] == 1
    assert sum(r.n for r in out.rates.collect()) == 3
