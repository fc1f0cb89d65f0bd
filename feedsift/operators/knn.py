"""Similarity join and scoring.

``knn_join`` is exact.  A small batch of queries is broadcast and the rated side
scanned where it lies; a large one meets the rated side cell by cell
(``operators/cells.py``): each query looks only at the cells that the triangle
inequality leaves open, or is compared with one run of rated vectors after the
other where it leaves most of them open.  Either way a task runs NumPy matrix
products and keeps the k best rated items per query (``operators/nearest.py``), and a final window picks the
global k; no pair is ever materialised as a row.

Distances are rounded to 6 decimals before ranking and ties are broken by
``item_id``, so the result is deterministic and equal to a brute-force SQL
ranking.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedsift.operators import cells
from feedsift.operators.cells import slices, stack
from feedsift.operators.common import bounded_broadcast
from feedsift.operators.nearest import Block, plain, within
from feedsift.settings import DEFAULT, Settings

# Metric names and their ordering; fixed by the reference's metric dispatch.
METRICS = {"L2": "asc", "L2_SQUARED": "asc", "IP": "desc", "COSINE": "desc"}

_ROUND = 6


def metric_order(metric: str) -> str:
    """T5: metric dispatch; an unknown metric is an error."""
    try:
        return METRICS[metric.upper()]
    except KeyError:
        raise ValueError(f"unsupported metric {metric!r}; expected one of {sorted(METRICS)}") from None


def within_threshold(distance: Column, metric: str, threshold: float | None) -> Column:
    """L2 keeps ``distance <= t``; IP and cosine keep ``distance >= t``; None disables."""
    if threshold is None:
        return F.lit(True)
    return distance <= F.lit(threshold) if metric_order(metric) == "asc" else distance >= F.lit(threshold)


def l2_normalise(vec: Column) -> Column:
    """``v / ||v||`` element-wise in the JVM (the norm is folded once per row, not per element)."""
    def unit(v):
        return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"),
                           lambda s: F.transform(v, lambda x: (x.cast("double") / F.sqrt(s)).cast("float")))
    return F.aggregate(F.array(vec), F.lit(None).cast("array<float>"), lambda acc, v: unit(v))


def _distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    ip = q @ r.T
    if metric == "IP":
        return ip
    if metric == "COSINE":
        qn = np.linalg.norm(q, axis=1)[:, None]
        rn = np.linalg.norm(r, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return ip / (qn * rn)
    sq = (q * q).sum(axis=1)[:, None] + (r * r).sum(axis=1)[None, :] - 2.0 * ip
    sq = np.maximum(sq, 0.0)
    return np.sqrt(sq) if metric == "L2" else sq


def _local_topk(q_ids: np.ndarray, q_vecs: np.ndarray, r_ids: np.ndarray, r_vecs: np.ndarray, k: int,
                metric: str, kth: np.ndarray | None = None) -> pd.DataFrame:
    """Exact top-k per query row inside one block pair, ties broken by item id; with ``kth`` only pairs whose
    key (a distance, or a similarity with its sign turned) is at most that."""
    desc = metric_order(metric) == "desc"
    out = []
    lost = pd.isna(r_ids)                               # null ids come first, as in Spark's order
    known = np.flatnonzero(~lost)
    r_order = np.r_[np.flatnonzero(lost), known[np.argsort(r_ids[known], kind="stable")]]     # tie-break by id == by position after this sort
    r_ids, r_vecs = r_ids[r_order], r_vecs[r_order]
    kk = min(k, len(r_ids))
    if metric != "COSINE" and kk and len(q_ids) and plain(q_vecs).all() and plain(r_vecs).all():
        for rows, cols, d in Block(r_vecs, metric).nearest(q_vecs, k, kth):
            out.append(pd.DataFrame({"query_id": q_ids[rows], "item_id": r_ids[cols], "distance": pd.array(d, dtype="Float64")}))
        return pd.concat(out, ignore_index=True)
    undefined = metric == "COSINE" or not (np.isfinite(q_vecs).all() and np.isfinite(r_vecs).all())
    for some in slices(len(q_ids), len(r_ids)):
        dist = _distances(q_vecs[some], r_vecs, metric)
        key = np.negative(dist) if desc else dist
        if undefined:
            key = np.where(np.isnan(key), np.inf, key)
        # candidates: as near as the k-th best, rounding allowed for (ties included)
        cut = np.full(len(dist), np.inf) if kth is None else within(kth[some])
        near = key <= cut[:, None]
        many = np.flatnonzero(near.sum(1) > (kk if kth is None else 16 * kk))
        if len(many):
            cut[many] = np.minimum(cut[many], within(np.partition(key[many], kk - 1, axis=1)[:, kk - 1]))
            near[many] = key[many] <= cut[many, None]
        rows, cols = np.nonzero(near)
        d = np.round(dist[rows, cols], _ROUND)
        by = np.where(np.isnan(d), np.inf, -d if desc else d)
        order = np.lexsort((cols, by, rows))            # row, then key, then id (cols sorted by id)
        rows, cols, d = rows[order], cols[order], d[order]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        rank_in_row = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        keep = rank_in_row < kk
        rows, cols, d = rows[keep], cols[keep], d[keep]
        out.append(pd.DataFrame({
            "query_id": q_ids[some][rows],
            "item_id": r_ids[cols],
            # an undefined similarity (zero vector under cosine) is NULL: it sorts last and passes no threshold
            "distance": pd.array(np.where(np.isnan(d), None, d), dtype="Float64"),
        }))
    if not out:
        return pd.DataFrame({"query_id": [], "item_id": [], "distance": []}, dtype=object)
    return pd.concat(out, ignore_index=True)


def knn_join(queries: DataFrame, rated: DataFrame, k: int, metric: str = "IP", *,
             query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding",
             settings: Settings = DEFAULT, keep_empty: bool = False) -> DataFrame:
    """The k nearest rated items for every query.

    Query ids are unique (a batch is keyed by item id).  Returns
    ``(query_id, item_id, distance, rnk)``; ``distance`` is rounded to 6
    decimals.  A batch of at most ``knn_broadcast_queries`` queries is broadcast
    and the rated side is scanned where it lies, each task keeping its k best per
    query; a larger batch meets the rated side by cells.  Which of the two, and
    the cells, are found by jobs that run while the plan is built (a count of at most
    that many ids comes first, so no vector is made for it).  With ``keep_empty``
    every query appears at least once: queries without any candidate carry a
    NULL ``item_id`` (used by scoring so that it never has to join back to the
    queries).
    """
    metric = metric.upper()
    desc = metric_order(metric) == "desc"
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("qv"))
    r = rated.select(F.col(item_id).alias("item_id"), F.col(vector).alias("rv"))
    if q.select("query_id").limit(settings.knn_broadcast_queries + 1).count() <= settings.knn_broadcast_queries:
        local = _scan_rated(q, q.where(F.col("qv").isNotNull()).toPandas(), r, k, metric)
    else:
        local = cells.candidates(q, r, k, metric, partial(_local_topk, k=k, metric=metric), desc,
                                 block=settings.knn_block_rows, max_pivots=settings.knn_pivots)
    dist = F.col("distance").desc_nulls_last() if desc else F.col("distance").asc_nulls_last()
    w = Window.partitionBy("query_id").orderBy(dist, F.col("item_id"))
    out = local.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
    if not keep_empty:
        return out
    return q.select("query_id").join(out, "query_id", "left").withColumn("rnk", F.coalesce("rnk", F.lit(1)))


def _scan_rated(ids: DataFrame, few: pd.DataFrame, rated: DataFrame, k: int, metric: str) -> DataFrame:
    """Each task's k nearest of a broadcast batch of queries by one scan of the rated side, which is not shuffled."""
    schema = T.StructType([T.StructField("query_id", ids.schema["query_id"].dataType),
                           T.StructField("item_id", rated.schema["item_id"].dataType), T.StructField("distance", T.DoubleType())])
    desc = metric_order(metric) == "desc"
    shared = ids.sparkSession.sparkContext.broadcast((few["query_id"].to_numpy(), stack(few["qv"])))

    def scan(batches):
        q_ids, q_vecs = shared.value
        best = None
        for b in batches:
            if len(b) == 0 or len(q_ids) == 0:
                continue
            got = _local_topk(q_ids, q_vecs, b["item_id"].to_numpy(), stack(b["rv"]), k, metric)
            best = got if best is None else pd.concat([best, got], ignore_index=True)
            best = best.sort_values(["distance", "item_id"], ascending=[not desc, True], na_position="last", kind="stable")
            best = best.groupby("query_id", sort=False, dropna=False).head(k)
        if best is not None:
            yield best

    return rated.where(F.col("rv").isNotNull()).mapInPandas(scan, schema)


def neighbours(queries: DataFrame, rated: DataFrame, meta: DataFrame, k: int, metric: str,
               threshold: float | None, *, self_exclude: bool = False, **kw) -> DataFrame:
    """J5 -> T3/T4 -> J6 (-> J7): k cut first, then threshold, metadata inner join, self exclusion.

    The order is the reference's and is kept on purpose: fewer than k may survive.
    ``meta`` has ``item_id, user_rating`` (one row per item).
    """
    nb = knn_join(queries, rated, k, metric, **kw)
    nb = nb.where(within_threshold(F.col("distance"), metric, threshold))
    nb = nb.join(bounded_broadcast(meta.select("item_id", "user_rating")), "item_id", "inner")
    if self_exclude:
        nb = nb.where(F.col("item_id") != F.col("query_id"))
    return nb


def relevance_score(queries: DataFrame, rated: DataFrame, meta: DataFrame, k: int, metric: str,
                    threshold: float | None, *, unknown: float = DEFAULT.unknown_score,
                    self_exclude: bool = False, **kw) -> DataFrame:
    """A1/A2: mean rating of the surviving neighbours; no neighbour -> ``unknown`` (-1).

    One row per query: ``(query_id, relevant_score, n_neighbours)``.  The KNN
    keeps every query (``keep_empty``), the metadata join is a left join and
    the survivors are decided by a flag, so no join back to the queries is
    needed.
    """
    nb = knn_join(queries, rated, k, metric, keep_empty=True, **kw)
    # metadata is one row per rated item: broadcast only when a count proves it small, else a shuffle join
    m = bounded_broadcast(meta.select("item_id", F.col("user_rating").cast("double").alias("_rating"),
                                      F.lit(True).alias("_meta")))
    nb = nb.join(m, "item_id", "left")
    ok = (F.col("item_id").isNotNull() & within_threshold(F.col("distance"), metric, threshold)
          & F.col("_meta").isNotNull())
    if self_exclude:
        ok = ok & (F.col("item_id") != F.col("query_id"))
    return (nb.groupBy("query_id")
            .agg(F.avg(F.when(ok, F.col("_rating"))).alias("_avg"),
                 F.count_if(ok).alias("n_neighbours"))
            .select("query_id",
                    F.coalesce(F.col("_avg"), F.lit(float(unknown))).alias("relevant_score"),
                    F.col("n_neighbours").cast("bigint").alias("n_neighbours")))


def similarity_topk(candidates: DataFrame, metric: str, threshold: float | None, k: int,
                    group: str = "query_id") -> DataFrame:
    """Over a candidate list per query, the threshold first, then the k best (ties by id)."""
    c = candidates.where(within_threshold(F.col("distance"), metric, threshold))
    dist = F.col("distance").desc() if metric_order(metric) == "desc" else F.col("distance").asc()
    w = Window.partitionBy(group).orderBy(dist, F.col("item_id").asc())
    return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fallback_partition(vectors: DataFrame, run_date: Column | str) -> DataFrame:
    """The rated collection for ``run_date`` if it has rows, else the one of the day before.

    ``vectors`` carries an ``as_of`` DATE.  The choice is a scalar aggregate
    (max usable date) joined back as a one-row broadcast, so only one date's
    rows flow on; no other partition is read past the filter.
    """
    d = F.to_date(F.lit(run_date)) if isinstance(run_date, str) else run_date
    usable = (vectors.where(F.col("as_of").isin(d, F.date_sub(d, 1)))
              .agg(F.max("as_of").alias("_chosen")))
    return (vectors.where(F.col("as_of").isin(d, F.date_sub(d, 1)))
            .join(F.broadcast(usable), F.col("as_of") == F.col("_chosen"), "inner")
            .drop("_chosen"))
