"""The exact join by cells: results against brute force, visits on clustered data, hot cells, undefined vectors."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedsift.operators import cells, knn
from feedsift.settings import Settings


def _frame(spark, x, name):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>").repartition(3)


def _brute(q, r, k, metric):
    d = knn._distances(np.array(q), np.array(r), metric).round(6)
    out = {}
    for i, row in enumerate(d):
        key = np.where(np.isnan(row), np.inf, -row if knn.metric_order(metric) == "desc" else row)
        out[i] = np.lexsort((np.arange(len(r)), key))[:k].tolist()
    return out


def _got(df):
    out = {}
    for x in df.collect():
        out.setdefault(x.query_id, []).append((x.rnk, x.item_id))
    return {q: [i for _, i in sorted(v)] for q, v in out.items()}


def _clustered(seed, groups, each, dim, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim)) * 5
    return (centre[:, None] + rng.normal(size=(groups, each, dim)) * spread).reshape(-1, dim)


@pytest.mark.parametrize("metric", ["L2", "L2_SQUARED", "IP", "COSINE"])
def test_clustered_and_scattered_vectors(spark, metric):
    few = Settings(knn_broadcast_queries=0, knn_block_rows=50)
    rng = np.random.default_rng(1)
    for x in (_clustered(2, 12, 25, 6, 0.2), rng.normal(size=(200, 10)) * rng.uniform(0.01, 20, (200, 1)), np.repeat(rng.normal(size=(5, 3)), 30, 0)):
        q = np.concatenate([x[::7], rng.normal(size=(9, x.shape[1]))])
        got = _got(knn.knn_join(_frame(spark, q, "query_id"), _frame(spark, x, "item_id"), 5, metric, settings=few))
        assert got == _brute(q, x, 5, metric)


@pytest.mark.parametrize("metric", ["L2_SQUARED", "COSINE"])
def test_queries_look_at_few_cells_of_clustered_data(spark, metric):
    x = _clustered(3, 40, 50, 8, 0.05)
    r = _frame(spark, x, "item_id").select("item_id", F.col("embedding").alias("rv"))
    q = _frame(spark, x[::4], "query_id").select("query_id", F.col("embedding").alias("qv"))
    c, dealt = cells.build(r, metric, block=100)
    assert len(c.pivots) == 45 and c.size.sum() == len(x)
    first = cells.first_visits(q, c, 4)
    near = cells.search(first, dealt, c, partial(knn._local_topk, k=4, metric=metric), block=100)
    sign = -1 if metric == "COSINE" else 1
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list(sign * F.col("distance"))).alias("keys")).select("query_id", F.try_element_at("keys", F.lit(4)).alias("kth"))
    visits = first.count() + cells.further_visits(q.join(kth, "query_id"), c, 4).count()
    assert visits <= 5 * q.count()                     # all pairs would be 45 a query


def test_a_cell_with_a_third_of_the_rows_is_dealt_to_many_tasks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.tile([[3.0, 1.0, 2.0]], (300, 1)), rng.normal(size=(600, 3)) * 10])
    r = _frame(spark, x, "item_id").select("item_id", F.col("embedding").alias("rv"))
    c, dealt = cells.build(r, "L2", block=40)
    parts = {(p.cell, p["sub"]): p["count"] for p in dealt.groupBy("cell", "sub").count().collect()}
    assert c.size.max() >= 300 and max(parts.values()) < 80
    few = Settings(knn_broadcast_queries=0, knn_block_rows=40)
    got = _got(knn.knn_join(_frame(spark, x, "query_id"), _frame(spark, x, "item_id"), 3, "L2", settings=few))
    assert got == _brute(x, x, 3, "L2")


def test_scattered_vectors_are_copied_for_blocks_not_for_cells(spark):
    """Where the bounds leave all cells open, a query meets about one copy for each block of rated vectors."""
    x = np.random.default_rng(7).normal(size=(1200, 24))
    r = _frame(spark, x, "item_id").select("item_id", F.col("embedding").alias("rv"))
    q = _frame(spark, x[::6], "query_id").select("query_id", F.col("embedding").alias("qv"))
    c, _ = cells.build(r, "IP", block=400)
    visits = cells.further_visits(q.withColumn("kth", F.lit(None).cast("double")), c, 4)
    assert len(c.pivots) == 35 and visits.count() <= 6 * q.count()
    few = Settings(knn_broadcast_queries=0, knn_block_rows=400)
    for metric in knn.METRICS:
        got = _got(knn.knn_join(_frame(spark, x, "query_id"), _frame(spark, x, "item_id"), 4, metric, settings=few))
        assert got == _brute(x, x, 4, metric)


def test_undefined_vectors_and_small_collections(spark):
    few = Settings(knn_broadcast_queries=0)
    x = [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [0.0, 2.0], None]
    q = [[0.0, 0.0], [1.0, 1.0], None]
    out = knn.knn_join(_frame(spark, q, "query_id"), _frame(spark, x, "item_id"), 3, "COSINE", settings=few)
    assert _got(out) == {0: [0, 1, 2], 1: [1, 3, 0]}
    kept = knn.knn_join(_frame(spark, q, "query_id"), _frame(spark, x, "item_id"), 3, "L2", settings=few, keep_empty=True)
    assert [r.item_id for r in kept.where("query_id = 2").collect()] == [None]
    none = _frame(spark, [None, None], "item_id")
    for metric in knn.METRICS:
        assert knn.knn_join(_frame(spark, q, "query_id"), none, 3, metric, settings=few).count() == 0
        assert knn.knn_join(_frame(spark, q, "query_id").limit(0), _frame(spark, x, "item_id"), 3, metric, settings=few).count() == 0


def test_rated_rows_without_an_id_are_ranked_too(spark):
    r = spark.createDataFrame([("b", [1.0, 0.0]), (None, [1.0, 0.0]), ("a", [0.0, 1.0])], "item_id string, embedding array<double>").coalesce(1)
    q = _frame(spark, [[1.0, 0.0]], "query_id")
    for few in (Settings(), Settings(knn_broadcast_queries=0)):
        got = knn.knn_join(q, r, 2, "IP", settings=few).orderBy("rnk").collect()
        assert [(x.item_id, x.distance) for x in got] == [(None, 1.0), ("b", 1.0)]


@pytest.mark.parametrize("metric", ["L2_SQUARED", "IP"])
def test_zones_that_no_query_visits_give_no_rows_for_text_ids(spark, metric):
    """An empty answer of a zone has the columns' own kinds, whatever kind the ids are."""
    few = Settings(knn_broadcast_queries=0, knn_block_rows=20)
    x = _clustered(8, 10, 20, 4, 0.01)
    q = x[:3]
    named = _frame(spark, q, "query_id").withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    items = _frame(spark, x, "item_id").withColumn("item_id", F.format_string("%04d", "item_id"))
    got = _got(knn.knn_join(named, items, 4, metric, settings=few))
    assert {int(i[1:]): [int(r) for r in v] for i, v in got.items()} == _brute(q, x, 4, metric)


def test_pivots_are_distinct_and_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(30, 4)), 3, 0)
    p = cells.fit_pivots(x, 10)
    d = cells.euclid(x, p)
    near = d.argmin(1)
    for metric in knn.METRICS:
        at = cells.unit(x) if metric == "COSINE" else x
        d = cells.euclid(at, p)
        near = d.argmin(1)
        per = lambda v, f: np.array([f(v[near == c]) if (near == c).any() else 0 for c in range(len(p))], float)
        c = cells.Cells(metric, p, np.bincount(near, minlength=len(p)), per(d.min(1), np.max), per(np.linalg.norm(x, axis=1), np.max))
        q = rng.normal(size=(20, 4)) * 3
        least = c.bounds(q)[1]
        key = knn._distances(q, x, metric) * (-1 if knn.metric_order(metric) == "desc" else 1)
        assert (least[:, near] <= key + 1e-9).all()


def test_embedding_counts_every_token(spark):
    from feedsift.operators import embed

    texts = ["Größe 12_3 ça, x x X ½ 二", "", None, "___", "word " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", embed.bucket_counts("t", 16).alias("n"), embed.hashing_embedding("t", 16).alias("e")).orderBy("i").collect()
    assert [sum(r.n) for r in rows] == [9, 0, 0, 0, 5000]
    assert all(len(r.e) == 16 and abs(sum(x * x for x in r.e) - (1 if sum(r.n) else 0)) < 1e-12 for r in rows)


def test_the_memo_of_tokens_is_bounded_in_tokens_and_characters():
    from feedsift.operators import embed

    embed._MEMO.pop(24, None)
    n = embed.count_tokens([" ".join(f"t{i}" for i in range(150_000)), "x" * 1_000_000, "t1 t1"], 24)
    memo = embed._MEMO.pop(24)
    assert n.sum(1).tolist() == [150_000, 1, 2] and (n[2] > 0).sum() == 1
    assert len(memo) <= 100_000 and max(map(len, memo)) <= 64


@pytest.mark.parametrize("metric", ["L2", "L2_SQUARED", "IP", "COSINE"])
def test_scattered_vectors_are_compared_run_by_run_without_copies(spark, metric, monkeypatch):
    """Every query has to look at nearly every zone: nothing is shuffled by zone, and the answer is that of brute force."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12))
    x[300:] = x[rng.integers(0, 40, 100)]                    # many equal vectors
    q = np.concatenate([x[::3], rng.normal(size=(150, 12))])
    runs, scan = [], cells.scan
    monkeypatch.setattr(cells, "scan", lambda *a, **kw: runs.append(kw["rows"]) or scan(*a, **kw))
    few = Settings(knn_broadcast_queries=0, knn_block_rows=20)
    joined = knn.knn_join(_frame(spark, q, "query_id"), _frame(spark, x, "item_id"), 3, metric, settings=few)
    assert runs == [100] and "FlatMapCoGroupsInPandas" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert _got(joined) == _brute(q, x, 3, metric)


def test_a_scan_by_runs_takes_odd_rows_and_text_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 8))
    x[7, 2], x[150] = np.nan, 1e20
    q = np.concatenate([x[:60], rng.normal(size=(80, 8))])
    rated = spark.createDataFrame([(None if i == 20 else f"i{i:04d}", [float(a) for a in v]) for i, v in enumerate(x)], "item_id string, embedding array<double>").repartition(3)
    few = Settings(knn_broadcast_queries=0, knn_block_rows=10)

    def pairs(df):
        return sorted((r.query_id, r.rnk, r.item_id or "", r.distance) for r in df.collect())

    monkeypatch.setattr(cells, "_COPIES", 0)
    got = pairs(knn.knn_join(_frame(spark, q, "query_id"), rated, 3, "L2_SQUARED", settings=few))
    monkeypatch.setattr(cells, "_COPIES", float("inf"))
    assert got == pairs(knn.knn_join(_frame(spark, q, "query_id"), rated, 3, "L2_SQUARED", settings=few)) and len(got) == 3 * len(q)


@pytest.mark.parametrize("metric", ["L2", "L2_SQUARED", "IP", "COSINE"])
def test_single_precision_only_narrows_the_choice(metric):
    """Vectors far from the origin and near to each other, and many at the same distance."""
    from feedsift.operators.nearest import Block

    rng = np.random.default_rng(7)
    for v, q in ((100 + rng.normal(size=(3000, 6)) * 1e-3, 100 + rng.normal(size=(40, 6)) * 1e-3), (rng.integers(0, 2, (3000, 5)) + 1.0, rng.integers(0, 2, (40, 5)) + 1.0)):
        want = _brute(q, v, 4, metric)
        kth = np.full(len(q), np.inf)
        for limit in (None, kth):
            got = {}
            for row, col, _ in Block(v, metric).nearest(q, 4, limit):
                for i, j in zip(row.tolist(), col.tolist()):
                    got.setdefault(i, []).append(j)
            assert got == want


def test_rated_vectors_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [float(i % 17), float(i % 5), 1.0]

    rated = spark.range(300).select(F.col("id").alias("item_id"), vector("id").alias("embedding"))
    knn.knn_join(_frame(spark, np.random.default_rng(8).normal(size=(50, 3)), "query_id"), rated, 2, "L2", settings=Settings(knn_broadcast_queries=0, knn_block_rows=50)).collect()
    assert made.value == 300
