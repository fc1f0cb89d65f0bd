"""Unit, brute-force and property tests for operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.operators import chunking as CH
from feedsift.operators import dedup as D
from feedsift.operators import enrich as EN
from feedsift.operators import filters as FL
from feedsift.operators import knn
from feedsift.operators import state as S
from feedsift.operators import stats as ST
from feedsift.settings import Settings
from feedsift.functions import text as X
from feedsift.sinks import documents as DOC
from tests.conftest import MEDIUM, SMALL


# ---------------------------------------------------------------- KNN == brute force, by cells and by a scan
@pytest.mark.parametrize("few", [0, 1000])
@pytest.mark.parametrize("metric", ["IP", "L2_SQUARED", "L2", "COSINE"])
def test_knn_equals_brute_force(spark, metric, few):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(37, 8)).round(2)
    r = rng.normal(size=(150, 8)).round(2)
    r[5] = r[6]                     # exact duplicate vectors -> ties broken by id
    qdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    rdf = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(r)], "item_id long, embedding array<double>")
    got = knn.knn_join(qdf, rdf, 3, metric, settings=Settings(knn_broadcast_queries=few, knn_block_rows=7))
    got = sorted((row.query_id, row.item_id, row.rnk) for row in got.collect())
    d = knn._distances(q, r, metric).round(6)
    want = []
    for i in range(len(q)):
        key = -d[i] if knn.metric_order(metric) == "desc" else d[i]
        order = sorted(range(len(r)), key=lambda j: (key[j], j))[:3]
        want += [(i, j, n + 1) for n, j in enumerate(order)]
    assert got == sorted(want)


def test_unknown_metric_is_an_error():
    with pytest.raises(ValueError):
        knn.metric_order("HAMMING")


def test_relevance_unknown_is_minus_one(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    r = spark.createDataFrame([(10, [0.0, 1.0])], "item_id long, embedding array<double>")
    meta = spark.createDataFrame([(10, 5)], "item_id long, user_rating int")
    out = knn.relevance_score(q, r, meta, 2, "IP", 0.34).collect()
    assert out[0].relevant_score == -1.0 and out[0].n_neighbours == 0


# ---------------------------------------------------------------- chunking
def test_recursive_chunks_bounded_and_cover(spark):
    text = ("alpha beta gamma. " * 50 + "\n\n" + "delta epsilon " * 80 + "\n" + "x" * 300).strip()
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "id long, body string")
    got: dict[int, list[str]] = {}
    for r in CH.recursive_chunks(df, "id", "body", 100, 20).orderBy("id", "chunk_no").collect():
        got.setdefault(r.id, []).append(r.chunk)
    assert set(got) == {1, 4} and got[4] == ["short"]
    assert all(0 < len(c) <= 100 for c in got[1])
    whole = got[1][0]
    for c in got[1][1:]:                                     # each chunk repeats at most 20 characters of the last
        k = max(k for k in range(21) if whole.endswith(c[:k]))
        whole += c[k:]
    assert whole == text


def test_pack_sentences_matches_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.b for r in docs.select("doc_id", CH.pack_sentences("text", 1800).alias("b")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == CH.pack_sentences_py(r.text, 1800)


def test_pack_sentences_oversize_first_block_is_empty(spark):
    df = spark.createDataFrame([("a" * 30 + ". b",)], "t string")
    assert df.select(CH.pack_sentences("t", 10).alias("b")).first().b == ["", "a" * 30, " b"]


def test_fixed_chunks_reassemble(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = CH.explode_chunks(df, "doc_id", "text", 1024, 128).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.chunk_no, r.chunk))
    for r in df.collect():
        parts = [c for _, c in sorted(by.get(r.doc_id, []))]
        rebuilt = parts[0] + "".join(p[128:] for p in parts[1:]) if parts else ""
        assert rebuilt == r.text


# ---------------------------------------------------------------- dedup / versions / state
def test_dedup_idempotent(spark):
    items = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "source")
    visited = items.where(F.col("id") % 3 == 0).select(F.col("id").alias("item_id"))
    once = D.anti_join_visited(items, visited, {"id": "item_id"})
    twice = D.anti_join_visited(once, visited, {"id": "item_id"})
    assert sorted(once.collect()) == sorted(twice.collect())


def test_latest_per_key_order_insensitive_and_first_tie(spark):
    rows = [(1, "2024-01-01", 0, "a"), (1, "2024-01-02", 1, "b"), (1, "2024-01-02", 2, "c"), (2, "2024-01-01", 3, "d")]
    df = spark.createDataFrame(rows, "k long, v string, arrival long, p string")
    out = {r.k: r.p for r in D.latest_per_key(df, "k", "v", "arrival").collect()}
    shuffled = {r.k: r.p for r in D.latest_per_key(df.orderBy(F.rand(3)), "k", "v", "arrival").collect()}
    assert out == shuffled == {1: "b", 2: "d"}
    assert {r.k: r.p for r in D.last_wins(df, "k", "arrival").collect()} == {1: "c", 2: "d"}


def test_upsert_first_vs_last_and_ttl(spark):
    state = spark.createDataFrame([(1, "old"), (2, "keep")], "k long, v string")
    delta = spark.createDataFrame([(1, "new1", 1), (1, "new2", 2), (3, "add", 1)], "k long, v string, s long")
    first = {r.k: r.v for r in S.upsert(state, delta.drop("s"), "k", overwrite=False).collect()}
    last = {r.k: r.v for r in S.upsert(state, delta, "k", overwrite=True, seq="s").collect()}
    assert first == {1: "old", 2: "keep", 3: "add"}
    assert last == {1: "new2", 2: "keep", 3: "add"}
    ttl = S.upsert(state, delta, "k", overwrite=False, ttl_seconds=60,
                   now=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), seq="s")
    got = {r.k: (r.v, r.expires_at is not None) for r in ttl.collect()}
    assert got[1] == ("new2", True) and got[2] == ("keep", False)


def test_watermark_never_moves_back(spark):
    stored = spark.createDataFrame([("a", "2024-01-05")], "source string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "source string, t string") \
        .withColumn("t", F.col("t").cast("timestamp_ntz"))
    out = {r.source: str(r.ts)[:10] for r in S.advance_watermarks(stored, batch, "source", "t").collect()}
    assert out == {"a": "2024-01-05", "b": "2024-01-02"}


# ---------------------------------------------------------------- traps
def test_unknown_score_passes_filters_but_not_digest(spark):
    df = spark.createDataFrame([(1, "l", -1.0), (2, "l", 3.0), (3, "l", 4.0)], "id long, list_name string, relevant_score double")
    assert {r.id for r in FL.per_list_threshold(df, FL.parse_overrides(spark, "l:0")).collect()} == {1, 3}
    dg = df.withColumn("user_rating", F.lit(5))
    assert {r.id for r in FL.digest_postfilter(dg).collect()} == {2, 3}


def test_override_parsing_skips_bad_entries(spark):
    o = {r.list_name: r.min_score for r in FL.parse_overrides(spark, "a:3,bad,b:4.5:x,c:0").collect()}
    assert o == {"a": 3.0, "b": 4.5, "c": 0.0}


def test_histogram_negative_in_lowest_bucket(spark):
    df = spark.createDataFrame([("l", -0.01), ("l", 0.55), ("l", 1.5)], "list_name string, rate double")
    out = {r.bucket: r.n for r in ST.rate_histogram(df, ["list_name"]).collect()}
    assert out == {"below_0.5": 1, "below_0.6": 1}


def test_parse_bool_raises_on_unknown(spark):
    df = spark.createDataFrame([("yes",), ("N",)], "v string")
    assert [r.b for r in df.select(X.parse_bool("v").alias("b")).collect()] == [True, False]
    with pytest.raises(Exception):
        spark.createDataFrame([("maybe",)], "v string").select(X.parse_bool("v")).collect()


def test_lenient_json_malformed_is_null(spark):
    df = spark.createDataFrame([('{"feedback": "x",\t"overall_score": 0}',), ('{"topics": [',), ("",)], "a string")
    out = df.select(X.parse_rank("a", short_post=True).alias("p")).collect()
    assert out[0].p.rate == -0.01 and out[0].p.feedback == "x"
    assert out[1].p.rate == -0.01 and out[1].p.topics == []
    assert out[2].p.rate == -0.01


def test_retry_bound():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("boom")
        return "ok"

    assert EN.with_retry(flaky, 3, 5.0, sleep=lambda s: None) == "ok"
    calls.clear()
    with pytest.raises(RuntimeError):
        EN.with_retry(lambda: (_ for _ in ()).throw(RuntimeError("x")), 3, 0, sleep=lambda s: None)


def test_read_through_calls_model_on_misses_only(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, body string")
    cache = spark.createDataFrame([(1, "cached")], "item_id long, value string")
    out, new = EN.read_through(items, "id", F.col("body"), cache, EN.DigestModel("S:"), "summary")
    got = {r.id: (r.summary, r.from_cache) for r in out.collect()}
    assert got[1] == ("cached", True) and got[2][0].startswith("S:") and not got[2][1]
    assert [r.item_id for r in new.collect()] == [2]


def test_checked_insert_rejects_duplicates(spark):
    existing = spark.createDataFrame([("c", "n")], "category string, name string")
    ok = DOC.checked_insert(existing, spark.createDataFrame([("c", "m")], "category string, name string"), ["category", "name"])
    assert ok.count() == 1
    with pytest.raises(Exception):
        DOC.checked_insert(existing, existing, ["category", "name"]).collect()


def test_translation_optional(spark):
    df = spark.createDataFrame([(1, "x")], "id long, t string")
    assert EN.translate(df, "t", None).first().translation == ""


def test_snapshot_write_and_read(spark, tmp_path):
    from feedsift.sources.scans import read_snapshot

    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source")
    DOC.write_snapshot(df, str(tmp_path), "r1")
    back = read_snapshot(spark, f"{tmp_path}/run_id=r1", df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert read_snapshot(spark, f"{tmp_path}/missing", df.schema).count() == 0


def test_broadcast_only_when_bounded(spark):
    from feedsift.operators.common import bounded_broadcast

    small = spark.range(10)
    plan = small.join(bounded_broadcast(small, 1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan
    big = bounded_broadcast(spark.range(1000), 1000)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()


def test_medium_knn_plan_has_no_cartesian(spark):
    from feedsift.catalog import QUERIES, load_all

    load_all()
    plan = QUERIES["relevance_score"](spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_state_store_merge_versions(spark, tmp_path):
    from feedsift.sinks.state_store import StateStore

    st = StateStore(spark, str(tmp_path / "state"))
    assert st.read("visited").count() == 0
    d1 = spark.createDataFrame([("ns", "src", "s", "a"), ("ns", "src", "s", "b")],
                               "namespace string, source string, scope string, item_id string")
    st.merge("visited", d1, overwrite=False)
    d2 = spark.createDataFrame([("ns", "src", "s", "b"), ("ns", "src", "s", "c")],
                               "namespace string, source string, scope string, item_id string")
    out = st.merge("visited", d2, overwrite=False)
    assert sorted(r.item_id for r in out.collect()) == ["a", "b", "c"]


def test_read_texts_missing_is_empty(spark, tmp_path):
    from feedsift.sources.scans import read_texts

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("hello\nworld")
    names = spark.createDataFrame([("a.txt",), ("b.txt",)], "name string")
    got = {r.name: r.text for r in read_texts(spark, names, str(tmp_path / "t")).collect()}
    assert got == {"a.txt": "hello\nworld", "b.txt": ""}
    assert {r.text for r in read_texts(spark, names, str(tmp_path / "none")).collect()} == {""}


def test_dedup_within_ttl_matches_brute_force(spark):
    from feedsift.catalog import QUERIES, load_all

    load_all()
    ev = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id", "event_id", "ts").collect()
    want = set()
    for uid in {r.user_id for r in ev}:
        last = None
        for r in sorted((r for r in ev if r.user_id == uid), key=lambda r: (r.ts, r.event_id)):
            if last is None or (r.ts - last).total_seconds() >= 86400:
                want.add(r.event_id)
                last = r.ts
    got = {r.arrival for r in QUERIES["dedup_within_ttl"](spark, SMALL).collect()}
    assert got == want


def test_period_start_supports_month_and_year(spark):
    now = "2024-03-31 12:00:00"
    row = spark.range(1).select(FL.period_start(now, "weekly").alias("w"), FL.period_start(now, "monthly").alias("m"),
                                FL.period_start(now, "yearly").alias("y")).first()
    assert str(row.w) == "2024-03-24 12:00:00" and str(row.m) == "2024-02-29 12:00:00" and str(row.y) == "2023-03-31 12:00:00"
    with pytest.raises(ValueError):
        FL.period_start(now, "daily")


def test_zero_means_missing(spark):
    # trap Q4: score 0 -> 1, rate 0 -> -0.01 (short posts), relevant 0 not published, override 0 -> default
    df = spark.createDataFrame([('{"topics": [{"topic": "a", "score": 0}], "overall_score": 0}',)], "a string")
    p = df.select(X.parse_rank("a", short_post=True).alias("p")).first().p
    assert p.topics[0].score == 1.0 and p.rate == -0.01
    rows = spark.createDataFrame([(1, "l", 0.0), (2, "l", 4.5)], "id long, list_name string, relevant_score double")
    pub = {r.id: r.relevant_score for r in DOC.published_rows(rows, name=F.lit("n"), source=F.lit("s"),
                                                              tags=F.array()).collect()}
    assert pub == {1: None, 2: 4.5}


def test_publish_skips_unknown_targets_and_counts_failures(spark):
    from feedsift.sinks.publish import publish_attempts, published_visited

    df = spark.createDataFrame([(1, "notion", "x"), (2, "other", "y"), (3, "notion", "z" * 20)],
                               "id long, target string, body string")
    too_long = F.when(F.length("body") > 10, F.lit("content too long"))
    att = publish_attempts(df, rejected=too_long, target=F.col("target"))
    got = {r.id: r.error for r in att.collect()}
    assert got == {1: None, 3: "content too long"}
    assert [r.id for r in published_visited(att, ["id"], namespace="ns", source="s").collect()] == ["1"]


def test_rank_gate_null_score_is_ranked(spark):
    df = spark.createDataFrame([(1, None, "short"), (2, 2.0, "short"), (3, None, "x" * 2001)],
                               "id long, relevant_score double, body string")
    out = {r.id: r.ranked for r in EN.classify_rank(df, "id", "relevant_score", F.col("body"), EN.RankModel()).collect()}
    assert out == {1: True, 2: False, 3: True}               # no gate by length unless it is asked for

    gate = Settings(rank_gate_max_chars=2000)
    out = {r.id: r.ranked for r in EN.classify_rank(df, "id", "relevant_score", F.col("body"), EN.RankModel(), settings=gate).collect()}
    assert out == {1: True, 2: False, 3: False}


def test_register_partitions_appends_new_only(spark):
    reg = spark.createDataFrame([(1, "a")], "partition_id int, source string")
    new = spark.createDataFrame([(1, "a"), (2, "b")], "partition_id int, source string")
    assert sorted(r.partition_id for r in DOC.register_partitions(reg, new).collect()) == [1, 2]


def test_fallback_called_only_for_empty_answers(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    out = EN.fallback_enrich(df, F.col("text"), EN.EmptyModel(), EN.DigestModel("S:"), "summary")
    rows = out.collect()
    assert all((r.used == "digest") == r.summary.startswith("S:") for r in rows)
    assert {r.used for r in rows} == {"digest", "flaky"}
    assert all(r.summary for r in rows)


def test_refine_versions_chain(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "id long, t string")
    out = {(r.id, r.version): r.text for r in EN.refine_versions(df, "id", "t", EN.DigestModel("S:"), 3).collect()}
    import hashlib

    h = lambda s: "S:" + hashlib.md5(s.encode()).hexdigest()
    assert out[(1, 1)] == h("a") and out[(1, 2)] == h(h("a")) and out[(1, 3)] == h(h(h("a")))
    assert out[(2, 3)] == ""


def test_page_text_all_text_nodes_but_scripts(spark):
    from feedsift.sources.html import page_text

    html = ("<!DOCTYPE html><html><head><title>T &amp; co</title><style>p{x:1}</style>"
            "<script>var a='</p>';</script></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav>"
            "<p>First  line</p>\n\n\n<p>Second &lt;b&gt;</p><div>Third</div></body></html>")
    df = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    got = {r.page_id: r.text for r in page_text(df).collect()}
    assert got[1] == "T & coHomeFirst  line\nSecond <b>Third"
    assert got[2] == ""


def test_rank_gate_measures_content_model_reads_text(spark):
    # trap Q21: the gate measures "title: text", the model is prompted with the text only
    df = spark.createDataFrame([(1, None, "t" * 1999, "body")], "id long, relevant_score double, title string, body string")
    content = F.concat(F.col("title"), F.lit(": "), F.col("body"))

    gate = Settings(rank_gate_max_chars=2000)
    out = EN.classify_rank(df, "id", "relevant_score", content, EN.RankModel(), model_text=F.col("body"), settings=gate).first()
    assert out.ranked is False            # 1999 + 2 + 4 > 2000 characters: gated
    ok = EN.classify_rank(df.withColumn("title", F.lit("t")), "id", "relevant_score",
                          F.concat(F.lit("t: "), F.col("body")), EN.RankModel(), model_text=F.col("body")).first()
    import hashlib

    assert ok.ranked and ok.feedback == "fb-" + hashlib.md5(b"body").hexdigest()[:6]


def test_cosine_zero_vector_never_ranks_first(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    r = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.5, 0.5]), (12, [-1.0, 0.2])], "item_id long, embedding array<double>")
    got = [(x.item_id, x.distance) for x in knn.knn_join(q, r, 3, "COSINE").orderBy("rnk").collect()]
    assert [g[0] for g in got] == [11, 12, 10] and got[-1][1] is None


def test_html_unescape_basic_and_full(spark):
    df = spark.createDataFrame([("a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#39;",), ("x &eacute; &#233; &hellip;",), (None,)], "u string")
    basic = [r.b for r in df.select(X.html_unescape_basic("u").alias("b")).collect()]
    full = [r.f for r in df.select(X.html_unescape_full("u").alias("f")).collect()]
    assert basic[0] == "a & b <c> \"d\" 'e'" and full[0] == basic[0]
    assert full[1] == "x é é …" and full[2] is None


def test_empty_inputs_cold_start(spark):
    """Cold start: empty batches, histories and collections flow through without errors."""
    items = spark.createDataFrame([], "id long, list_name string, title string, body string")
    some = spark.createDataFrame([(1, "l", "t", "b")], "id long, list_name string, title string, body string")
    visited = spark.createDataFrame([], "item_id long, list_name string")
    on = {"id": "item_id", "list_name": "list_name"}
    assert D.anti_join_visited(items, visited, on).count() == 0
    assert D.anti_join_visited(some, visited, on).count() == 1
    assert D.dedup_tallies(some, visited, on, ["list_name"]).first().new == 1
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    empty_vec = spark.createDataFrame([], "item_id long, embedding array<double>")
    empty_meta = spark.createDataFrame([], "item_id long, user_rating int")
    assert knn.knn_join(q.limit(0), empty_vec, 2, "IP").count() == 0
    assert [r.relevant_score for r in knn.relevance_score(q, empty_vec, empty_meta, 2, "IP", 0.3).collect()] == [-1.0]
    state = spark.createDataFrame([], "k long, v string")
    delta = spark.createDataFrame([(1, "a")], "k long, v string")
    assert [r.v for r in S.upsert(state, delta, "k", overwrite=False).collect()] == ["a"]
    assert S.upsert(state, state, "k", overwrite=True).count() == 0
    wm = spark.createDataFrame([], "source string, ts timestamp_ntz")
    batch = spark.createDataFrame([], "source string, t timestamp_ntz")
    assert S.advance_watermarks(wm, batch, "source", "t").count() == 0
    assert ST.funnel_counts(items, ["list_name"], {"total_input": F.lit(True)}).count() == 0
    assert CH.explode_chunks(items, "id", "body", 1024, 128).count() == 0
    assert EN.classify_rank(items.withColumn("relevant_score", F.lit(1.0)), "id", "relevant_score", F.col("body"),
                            EN.RankModel()).count() == 0


def test_package_zip_holds_the_package():
    import zipfile

    from feedsift.session import package_zip

    names = zipfile.ZipFile(package_zip()).namelist()
    assert "feedsift/__init__.py" in names and "feedsift/operators/knn.py" in names
    assert all(n.endswith(".py") for n in names)


def test_recursive_chunks_cover_whole_texts(spark):
    """M1 (separator-aware) on the real documents: chunks are in-order substrings of at most 2048 characters that
    together cover every character of the text."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    chunks: dict[int, list[tuple[int, str]]] = {}
    for r in CH.recursive_chunks(df, "doc_id", "text", 2048, 256).collect():
        chunks.setdefault(r.doc_id, []).append((r.chunk_no, r.chunk))
    for k, text in docs.items():
        end = start = 0
        for _, ch in sorted(chunks.get(k, [])):
            assert 0 < len(ch) <= 2048
            pos = text.find(ch, max(start, end - 256))
            assert 0 <= pos <= end, (k, ch[:40])
            start, end = pos, max(end, pos + len(ch))
        assert end == len(text), k


def test_state_store_ignores_a_version_that_was_not_committed(spark, tmp_path):
    """A merge that stopped midway leaves the last committed version current."""
    from feedsift.sinks.state_store import StateStore

    st = StateStore(spark, str(tmp_path / "state"), keep=2)
    row = lambda i: spark.createDataFrame([("ns", "src", "s", i)], "namespace string, source string, scope string, item_id string")
    for i in "abcd":
        st.merge("visited", row(i), overwrite=False)
    (tmp_path / "state" / "visited" / "v-999999999999-x").mkdir()
    assert sorted(r.item_id for r in st.read("visited").collect()) == list("abcd")
    assert len(st._versions("visited")) == 3


def test_expired_state_does_not_win_a_first_write(spark):
    import datetime as dt

    from feedsift.operators.state import upsert

    now = dt.datetime(2024, 1, 2)
    state = spark.createDataFrame([("k", "old", dt.datetime(2024, 1, 1)), ("m", "kept", None)], "id string, v string, expires_at timestamp")
    delta = spark.createDataFrame([("k", "new"), ("m", "new")], "id string, v string")
    got = {r.id: r.v for r in upsert(state, delta, "id", overwrite=False, now=now).collect()}
    assert got == {"k": "new", "m": "kept"}


def test_duplicate_markers_count_once(spark):
    from feedsift.operators import dedup as DD

    items = spark.createDataFrame([(1, "a"), (2, "a")], "id long, l string")
    visited = spark.createDataFrame([(1, "a"), (1, "a")], "item_id long, l string")
    on = {"id": "item_id", "l": "l"}
    t = DD.dedup_tallies(items, visited, on, ["l"]).first()
    assert (t.total, t.duplicate, t["new"]) == (2, 1, 1)
    pages = spark.createDataFrame([(1, 5)], "page_id long, user_rating int")
    state = spark.createDataFrame([(1, 5), (1, 5)], "page_id long, user_rating int")
    assert DD.rating_change_split(pages, visited.select("item_id"), state).count() == 1


def test_composite_watermarks_do_not_repeat_rows(spark):
    from feedsift.operators.state import since_watermark

    rows = spark.createDataFrame([("s", "x", 5), ("s", "y", 5), ("t", None, 5)], "source string, category string, ts int")
    wm = spark.createDataFrame([("s", "x", 7), ("s", "x", 3), ("s", "y", 4), ("t", None, 9)], "source string, category string, ts int")
    got = since_watermark(rows, wm, ["source", "category"], "ts", strict=False, default_ts=0).collect()
    assert [(r.source, r.category) for r in got] == [("s", "y")]


def test_one_id_in_two_lists_is_scored_in_each(spark):
    from feedsift.plans import jobs as J

    items = spark.createDataFrame([("x", "tech", "t", "alpha beta"), ("x", "news", "t", "gamma delta")], "id string, list_name string, title string, body string")
    rated = spark.createDataFrame([(1, "tech t: alpha beta"), (2, "news t: gamma delta")], "id long, text string")
    meta = spark.createDataFrame([(1, 5), (2, 1)], "item_id long, user_rating int")
    visited = spark.createDataFrame([], "item_id string, list_name string")

    out = J.curate(items, visited, J.rated_vectors_of(rated, F.col("text")), meta, settings=Settings(neighbours=1, min_score=0.5))
    assert {r.list_name: r.relevant_score for r in out.published.collect()} == {"tech": 5.0, "news": 1.0}
    assert {(r.list_name, r.n) for r in out.funnel.where("stage = 'total_input'").collect()} == {("tech", 1), ("news", 1)}


def test_feed_days(spark):
    from feedsift.functions.text import feed_day

    cases = {"Thu, 03 Mar 2022 08:00:00 GMT": "2022-03-03", "Thu, 03 Mar 2022 23:30:00 -0500": "2022-03-04", "3 Mar 2022 01:00 +0900": "2022-03-02",
             "2022-03-03T23:30:00-05:00": "2022-03-04", "2022-03-03": "2022-03-03", "2022-03-03T08:00:00Z": "2022-03-03", "soon": None, "": None, None: None,
             "Thu, 31 Feb 2022 08:00:00 GMT": None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.d for r in df.select("i", feed_day("c").alias("d")).orderBy("i").collect()] == list(cases.values())


def test_a_failing_text_is_isolated(spark):
    from feedsift.operators.enrich import model_attempt

    class Picky:
        name = "picky"

        def generate(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return ["ok:" + t for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "id long, t string").coalesce(1)
    got = {r.id: (r.x.answer, r.x.error) for r in df.select("id", model_attempt(Picky(), F.col("t"), tries=2, wait=0).alias("x")).collect()}
    assert got == {1: ("ok:a", None), 2: (None, "ValueError: bad text"), 3: ("ok:c", None)}


def test_duplicate_keys_within_an_insert_fail(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="duplicate key"):
        DOC.checked_insert(spark.createDataFrame([], "k long"), new, ["k"]).collect()


def test_replayed_publish_gives_the_same_rows(spark, tmp_path):
    from feedsift.sinks.publish import publish_attempts, write_batch

    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, body string")
    att = publish_attempts(df, rejected=F.when(F.col("id") == 2, F.lit("no")))
    paths = [str(tmp_path / p) for p in ("visited", "out", "attempts")]
    for _ in range(2):
        assert write_batch(att, *paths, ["id"], namespace="n", source="s", run_id="r1") == {"total": 2, "error": 1}
    assert [r.id for r in spark.read.parquet(paths[1]).collect()] == [1]
    assert spark.read.parquet(paths[0]).count() == 1


def test_whole_texts_reach_embedding_and_summary(spark):
    """A change at the tail of a 100,000-character text changes its embedding, its summary and its score text."""
    from feedsift.functions.text import score_text_feed
    from feedsift.operators import enrich as EN2
    from feedsift.operators.embed import hashing_embedding

    base = "word " * 20_000
    df = spark.createDataFrame([(1, base + "alpha"), (2, base + "omega")], "id long, t string")
    e = df.select("id", hashing_embedding("t").alias("e"), score_text_feed(F.lit("t"), F.lit("l"), "t").alias("s")).orderBy("id").collect()
    assert e[0].e != e[1].e and e[0].s != e[1].s
    s = EN2.mapreduce_summary(df, "id", "t", EN2.DigestModel("M:"), EN2.DigestModel("S:")).orderBy("id").collect()
    assert s[0].summary != s[1].summary


def test_building_queries_runs_no_job(spark):
    """Plans are built without jobs, but for schema reads, the KNN block count and checkpoints."""
    from feedsift.catalog import QUERIES, load_all

    load_all()
    sc = spark.sparkContext
    for name in ("dedup_visited", "funnel_counts", "mapreduce_summary", "cached_enrich", "pull_since_watermark", "page_text"):
        QUERIES[name](spark, SMALL)                      # reads the schemas once
        sc.setJobGroup(f"build-{name}", name)
        QUERIES[name](spark, SMALL)
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert all(s is None or s.numTasks <= 1 for s in stages), (name, len(jobs))
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_a_day_is_read_line_by_line(spark):
    """The model sees a day's lines in order without a string of the day; one that wants whole texts gets them."""
    import datetime as dt
    import hashlib

    from feedsift.operators import enrich as EN
    from feedsift.sinks import records as R

    at = lambda d, m: dt.datetime(2024, 1, d, 0, m)
    notes = [(3, "c", "third", at(1, 9)), (1, "a", "first.", at(1, 1)), (2, "b", None, at(1, 1)), (4, "d", "alone", at(2, 0)), (5, "e", "lost", None)]
    df = spark.createDataFrame(notes, "id int, title string, content string, created_time timestamp_ntz").repartition(4)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    text = {1: "a first.\nb \nc third\n", 2: "d alone\n"}

    out = R.journal_refined(df, EN.DigestModel("S:"))
    assert "listagg" not in out._jdf.queryExecution().toString()
    assert {r.day.day: (r.n_notes, r.refined.rewrite) for r in out.collect()} == {d: (n, "S:" + md5("rewrite|" + text[d])) for d, n in ((1, 3), (2, 1))}
    assert {r.refined.title for r in out.collect()} == {"S:" + md5("title|S:" + md5("rewrite|" + t)) for t in text.values()}

    class Whole:
        name = "whole"

        def generate(self, texts):
            if any("alone" in t for t in texts):
                raise RuntimeError("no")
            return [t.upper() for t in texts]

    lines = R._day_lines(df, None)
    got = EN.read_lines(lines, "day", R.LINE_ORDER, "line", Whole(), before="> ", tries=1, wait=0)
    assert {r.day.day: r.answer for r in got.collect()} == {1: "> " + text[1].upper(), 2: None}

    days = {r.day.day: (r.n_notes, r.n_chars, r.text_md5) for r in R.journal_days(df, "2024-01-01", "2024-01-03").collect()}
    assert days == {1: (3, len(text[1]), md5(text[1])), 2: (1, len(text[2]), md5(text[2])), 3: (0, 0, md5(""))}


def test_batches_of_long_texts_are_short(spark):
    """A Python worker never gets 10,000 long texts at a time."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    texts = spark.range(0, 12_000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("t"))
    assert texts.mapInArrow(rows, "n long").agg(F.max("n")).first()[0] < 17 << 20
