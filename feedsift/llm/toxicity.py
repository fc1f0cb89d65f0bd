"""Toxicity by non-negative positive-unlabelled learning.

A linear model over the set of a text's words (by 64-bit hash), fitted with numpy on the
driver from confirmed toxic documents (P) and texts whose labels are not looked
at (U). The risk is ``pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))`` with the
logistic loss: where the second part falls below zero, its gradient is reversed,
which keeps the model from fitting U as all negative. The class prior ``pi`` is
the share of toxic rows among the labelled training rows.

The fit uses a bounded sample (``max_positive`` and ``max_unlabelled`` documents,
the first by a hash of the id; features only, never texts, come to the driver).
Scoring reads every whole text in one pass without a shuffle.

Null and empty texts have no words; their score is the model's intercept.
Repeated rows score alike. Without any positive row every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, crc_fold, numbered, span_hash, text_udf, word_spans

#: Words are runs of ASCII letters, digits and non-ASCII bytes, without regard to ASCII case.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word hashes of each text, joined, and each text's offset in them."""
    data = LOWER[data] if len(data) else data
    starts, ends, first = word_spans(data, off, _WORD)
    h = span_hash(data, starts, ends)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.searchsorted(text[keep], np.arange(len(off)))


@dataclass
class Model:
    """Weights of the words (sorted 64-bit hashes) that have one."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        f, at = features(data, off)
        w = np.zeros(len(f))
        if len(self.words) and len(f):
            k = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
            w = np.where(self.words[k] == f, self.weights[k], 0.0)
        total = np.concatenate([[0.0], np.cumsum(w)])
        return 1 / (1 + np.exp(-np.clip(total[at[1:]] - total[at[:-1]] + self.bias, -60, 60)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 300, rate: float = 0.05,
        decay: float = 1e-4, min_docs: int = 5, min_z: float = 4.0) -> Model:
    """Adam on the non-negative risk. Only words in at least ``min_docs`` sampled documents get a weight whose shares
    of P and U differ by at least ``min_z`` standard errors: the others would only let the model learn single texts by heart."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model(np.empty(0, np.uint64), np.empty(0), -60.0)
    docs = [*positive, *unlabelled]
    words, x = np.unique(np.concatenate(docs), return_inverse=True)
    n = np.array([len(d) for d in docs])
    row = np.repeat(np.arange(len(docs)), n)
    is_p = np.arange(len(docs)) < len(positive)
    p, u = len(positive), len(unlabelled)
    of_p = np.bincount(x[is_p[row]], minlength=len(words))
    both = np.bincount(x, minlength=len(words))
    share = both / len(docs)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / p + 1 / u))
    z = np.abs(of_p / p - (both - of_p) / u) / spread
    used = np.flatnonzero((both >= min(min_docs, p)) & (z >= min_z))
    new = np.full(len(words), -1)
    new[used] = np.arange(len(used))
    x = new[x]
    x, row = x[x >= 0], row[x >= 0]
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        g = np.bincount(row, w[x], len(docs)) + b
        s = 1 / (1 + np.exp(-np.clip(g, -60, 60)))
        loss_neg = np.logaddexp(0, g)
        slack = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
        rest = np.where(is_p, -prior * s / p, s / u)                       # slope of the negative part
        d = np.where(is_p, -prior * (1 - s) / p, 0) + rest if slack >= 0 else -rest
        grad = np.append(np.bincount(x, d[row], len(used)) + decay * w * (slack >= 0), d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(words[used], w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, max_positive: int = 1500, max_unlabelled: int = 6000) -> Model:
    """Fit on the rows whose crc32 fold isn't 0; conflicting labels of one id count as toxic, null labels as none."""
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where(F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0))
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = d.select("doc_id").distinct()
    count = known.join(ids, "doc_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("p")).first()
    if not count.p:
        return fit([], [], 0.0)
    pos = known.where("toxic = 1").join(ids, "doc_id", "left_semi").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    unl = ids.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(max_unlabelled)

    def listed(data, off):
        f, at = features(data, off)
        return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(f.view(np.int64))).cast(pa.list_(pa.int64()))

    sample = pos.withColumn("p", F.lit(1)).unionByName(unl.withColumn("p", F.lit(0)))
    # at most max_positive + max_unlabelled ids, so broadcasting them is bounded
    got = d.join(F.broadcast(sample), "doc_id").select("doc_id", "p", text_udf(listed, "array<bigint>")("text").alias("f")).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["p"].to_pylist(), range(got.num_rows)))
    f = got["f"].combine_chunks()
    f = f.chunk(0) if isinstance(f, pa.ChunkedArray) else f
    off, val = np.asarray(f.offsets), np.asarray(f.values).view(np.uint64)
    part = {k: [val[off[i]:off[i + 1]] for _, p, i in rows if p == k] for k in (1, 0)}
    return fit(part[1], part[0], min(0.99, max(0.001, count.p / count.n)))


def scored(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column of the toxicity of each whole text, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)        # words of the bounded sample only

    def score(data, off):
        return pa.array(shared.value.score(data, off), pa.float64())

    return docs.withColumn(name, text_udf(score, "double")(F.col(text_col)))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, with their own columns."""
    plain, named, _ = numbered(docs)
    judged = scored(plain, train(docs, labels), "__toxicity", named("text"))
    return judged.where(F.col("__toxicity") < threshold).drop("__toxicity").toDF(*docs.columns)
