"""Scoring queries: KNN join, thresholds, relevance score."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from feedsift.bind import binding
from feedsift.catalog import register
from feedsift.operators import knn
from feedsift.settings import DEFAULT

# Similarity cut on the test vectors (FIXTURES §3): inner product >= 0.34, or squared L2 <= 1.32.
IP_CUT = 0.34
L2SQ_CUT = 1.32

_IP = "round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6)"
_L2SQ = "round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"

_KNN_SQL = """
, pairs AS (SELECT q.query_id, r.item_id, {dist} AS distance FROM vec_queries q, vec_rated r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, item_id) AS rnk FROM pairs)
"""


def _knn_cte(dist: str, order: str) -> str:
    return _KNN_SQL.format(dist=dist, order=order)


@register("relevance_score", uses=("vec_queries", "vec_rated", "rated_meta"), sql=_knn_cte(_IP, "DESC") + """
, kept AS (SELECT k.query_id, m.user_rating FROM ranked k JOIN rated_meta m ON k.item_id = m.item_id
           WHERE k.rnk <= 2 AND k.distance >= 0.34)
SELECT q.query_id, round(coalesce(avg(CAST(k.user_rating AS DOUBLE)), -1.0), 6) AS relevant_score,
       CAST(count(k.user_rating) AS BIGINT) AS n_neighbours
FROM vec_queries q LEFT JOIN kept k ON q.query_id = k.query_id GROUP BY q.query_id
""")
def relevance_score(spark, sf):
    """A1 minimum slice: k=2 by inner product, cut ip >= 0.34, metadata join, mean rating, -1 if none."""
    q = binding(spark, sf, "vec_queries")
    r = binding(spark, sf, "vec_rated")
    meta = binding(spark, sf, "rated_meta")
    out = knn.relevance_score(q, r, meta, k=2, metric="IP", threshold=IP_CUT)
    return out.select("query_id", F.round("relevant_score", 6).alias("relevant_score"), "n_neighbours")


def _neighbour_sql(dist: str, order: str, cut: str, k: int = 2) -> str:
    return _knn_cte(dist, order) + f"""
SELECT query_id, item_id, distance, CAST(rnk AS INTEGER) AS rnk FROM ranked WHERE rnk <= {k} AND distance {cut}"""


_COS = ("round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / "
        "(sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * "
        "sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]))), 6)")
_L2SQ_EXP = ("round(greatest(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + "
             "list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[]) - "
             "2 * list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 0), 6)")


def _nb(spark, sf, k, metric, cut):
    q = binding(spark, sf, "vec_queries")
    r = binding(spark, sf, "vec_rated")
    nb = knn.knn_join(q, r, k, metric)
    nb = nb.where(knn.within_threshold(F.col("distance"), metric, cut))
    return nb.select("query_id", "item_id", "distance", F.col("rnk").cast("int").alias("rnk"))


@register("knn_join_l2", uses=("vec_queries", "vec_rated"), sql=_neighbour_sql(_L2SQ_EXP, "ASC", f"<= {L2SQ_CUT}"))
def knn_join_l2(spark, sf):
    """k=2 nearest by squared L2, then the cut <= 1.32."""
    return _nb(spark, sf, 2, "L2_SQUARED", L2SQ_CUT)


@register("knn_join_cosine", uses=("vec_queries", "vec_rated"), sql=_neighbour_sql(_COS, "DESC", f">= {IP_CUT}"))
def knn_join_cosine(spark, sf):
    """k=2 nearest by cosine similarity, then the cut >= 0.34."""
    return _nb(spark, sf, 2, "COSINE", IP_CUT)


@register("knn_with_metadata", uses=("vec_queries", "vec_rated", "rated_meta"), sql=_knn_cte(_IP, "DESC") + f"""
SELECT k.query_id, k.item_id, k.distance, m.user_rating FROM ranked k JOIN rated_meta m ON k.item_id = m.item_id
WHERE k.rnk <= 2 AND k.distance >= {IP_CUT}""")
def knn_with_metadata(spark, sf):
    """Neighbours without live metadata are dropped after the k cut (fewer than k may remain)."""
    nb = knn.neighbours(binding(spark, sf, "vec_queries"), binding(spark, sf, "vec_rated"),
                        binding(spark, sf, "rated_meta"), 2, "IP", IP_CUT)
    return nb.select("query_id", "item_id", "distance", "user_rating")


@register("digest_score", uses=("rated_meta",), sql=f"""
, e AS (SELECT vec_id, embedding FROM embeddings)
, p AS (SELECT q.vec_id AS query_id, r.vec_id AS item_id,
               round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS distance FROM e q, e r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, item_id) AS rnk FROM p)
, kept AS (SELECT k.query_id, m.user_rating FROM ranked k JOIN rated_meta m ON k.item_id = m.item_id
           WHERE k.rnk <= 4 AND k.distance >= {IP_CUT} AND k.item_id <> k.query_id)
SELECT e.vec_id AS query_id, round(coalesce(avg(CAST(kept.user_rating AS DOUBLE)), -1.0), 6) AS relevant_score,
       CAST(count(kept.user_rating) AS BIGINT) AS n_neighbours
FROM e LEFT JOIN kept ON e.vec_id = kept.query_id GROUP BY e.vec_id""")
def digest_score(spark, sf):
    """Digest pages scored against the collection holding them: k=4, self excluded after the cut."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    r = e.select(F.col("vec_id").alias("item_id"), "embedding")
    out = knn.relevance_score(q, r, binding(spark, sf, "rated_meta"), k=4, metric="IP", threshold=IP_CUT,
                              self_exclude=True)
    return out.select("query_id", F.round("relevant_score", 6).alias("relevant_score"), "n_neighbours")


def _cells_sql(dist: str, order: str) -> str:
    return f"""
, p AS (SELECT q.vec_id AS query_id, r.vec_id AS item_id, {dist} AS distance FROM embeddings q, embeddings r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, item_id) AS rnk FROM p)
SELECT query_id, item_id, distance, CAST(rnk AS INTEGER) AS rnk FROM ranked WHERE rnk <= 4"""


def _by_cells(spark, sf, metric):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    nb = knn.knn_join(e.select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"),
                      4, metric, settings=replace(DEFAULT, knn_broadcast_queries=0))
    return nb.select("query_id", "item_id", "distance", F.col("rnk").cast("int").alias("rnk"))


@register("knn_cells_l2", uses=(), sql=_cells_sql(_L2SQ_EXP, "ASC"))
def knn_cells_l2(spark, sf):
    """Every vector's 4 nearest of all by squared L2, cell by cell, whatever the size of the batch."""
    return _by_cells(spark, sf, "L2_SQUARED")


@register("knn_cells_ip", uses=(), sql=_cells_sql(_IP, "DESC"))
def knn_cells_ip(spark, sf):
    """Every vector's 4 largest inner products with all, cell by cell."""
    return _by_cells(spark, sf, "IP")


@register("knn_cells_cosine", uses=(), sql=_cells_sql(_COS, "DESC"))
def knn_cells_cosine(spark, sf):
    """Every vector's 4 nearest of all by cosine, cell by cell."""
    return _by_cells(spark, sf, "COSINE")


_FALLBACK_DATE = "2024-01-21"


@register("knn_fallback_partition", uses=("vec_queries", "vec_rated"), sql=f"""
, v AS (SELECT item_id, embedding, DATE '2024-01-20' - as_of_offset AS as_of FROM vec_rated)
, chosen AS (SELECT max(as_of) AS d FROM v WHERE as_of IN (DATE '{_FALLBACK_DATE}', DATE '{_FALLBACK_DATE}' - 1))
, r AS (SELECT item_id, embedding, as_of FROM v WHERE as_of = (SELECT d FROM chosen))
, pairs AS (SELECT q.query_id, r.item_id, r.as_of, {_IP} AS distance FROM vec_queries q, r)
, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance DESC, item_id) AS rnk FROM pairs)
SELECT query_id, item_id, as_of, distance FROM ranked WHERE rnk <= 2""")
def knn_fallback_partition(spark, sf):
    """Run date 2024-01-21 has no collection, so yesterday's (2024-01-20) is searched."""
    v = binding(spark, sf, "vec_rated").withColumn(
        "as_of", F.date_sub(F.to_date(F.lit("2024-01-20")), F.col("as_of_offset")))
    chosen = knn.fallback_partition(v, _FALLBACK_DATE)
    nb = knn.knn_join(binding(spark, sf, "vec_queries"), chosen, 2, "IP")
    dates = chosen.select("item_id", "as_of")
    return nb.join(dates, "item_id").select("query_id", "item_id", "as_of", "distance")


def _topk_sql(dist: str, order: str, cut: str) -> str:
    return _knn_cte(dist, order) + f"""
, cand AS (SELECT * FROM ranked WHERE rnk <= 10 AND distance {cut})
, re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance {order}, item_id) AS r2 FROM cand)
SELECT query_id, item_id, distance FROM re WHERE r2 <= 2"""


@register("topk_l2", uses=("vec_queries", "vec_rated"), sql=_topk_sql(_L2SQ_EXP, "ASC", f"<= {L2SQ_CUT}"))
def topk_l2(spark, sf):
    """Over 10 searched candidates, keep distance <= 1.32, then the 2 smallest."""
    cand = knn.knn_join(binding(spark, sf, "vec_queries"), binding(spark, sf, "vec_rated"), 10, "L2_SQUARED")
    out = knn.similarity_topk(cand, "L2_SQUARED", L2SQ_CUT, 2)
    return out.select("query_id", "item_id", "distance")


@register("topk_cosine", uses=("vec_queries", "vec_rated"), sql=_topk_sql(_IP, "DESC", f">= {IP_CUT}"))
def topk_cosine(spark, sf):
    """T4/T5: over 10 searched candidates (IP on unit vectors), keep >= 0.34, then the 2 largest."""
    cand = knn.knn_join(binding(spark, sf, "vec_queries"), binding(spark, sf, "vec_rated"), 10, "IP")
    out = knn.similarity_topk(cand, "IP", IP_CUT, 2)
    return out.select("query_id", "item_id", "distance")


@register("l2_normalise", uses=(), sql="""
, n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT)) AS v FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS sq_norm,
       round(CAST(v[1] AS DOUBLE), 6) AS first FROM n""")
def l2_normalise(spark, sf):
    """Unit vectors (JVM-side higher-order functions)."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", knn.l2_normalise(F.col("embedding")).alias("v"))
    sq = F.aggregate("v", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return e.select("vec_id", F.round(sq, 5).alias("sq_norm"), F.round(F.element_at("v", 1).cast("double"), 6).alias("first"))
