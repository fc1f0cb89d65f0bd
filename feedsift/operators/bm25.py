"""Relevance search over stored texts (M9): a BM25 inverted index as tables.

Postings are (token, doc_id, tf) rows with the document's length, dealt by document: only the texts are shuffled, once for each
pass, and everything that is grouped by document (its length, its postings, its scores) stays in the task that has it. A batch of
queries whose estimated size is small is broadcast: a search then makes the postings of the queries' tokens only, adds up the parts
of a score per (query, document) in place, and the best k of each task are all that is shuffled. A frequent token's rows are never
gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedsift.operators.classify import tokens
from feedsift.operators.common import BROADCAST_MAX_BYTES, estimated_bytes

K1, B = 1.5, 0.75
DIGITS = 6


@dataclass
class Index:
    """``postings``: token, doc_id, tf, n_tokens; ``weights``: token, df; and the size of the collection."""

    postings: DataFrame
    weights: DataFrame
    docs: int
    mean_tokens: float


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of all whole texts; rows of one id are one document, a text without tokens counts for the collection's size."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = texts.select("doc_id", F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    words = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.collect_list("text").alias("texts")) \
        .select("doc_id", F.flatten(F.transform("texts", tokens)).alias("words"))
    postings = words.select("doc_id", F.size("words").cast("long").alias("n_tokens"), F.explode("words").alias("token")) \
        .groupBy("doc_id", "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf")).select("token", "doc_id", "tf", "n_tokens")
    return Index(postings, postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), whole.n, float(whole["mean"] or 0))


def part_score(tf: Column, df: Column, n_tokens: Column, docs: int, mean: float) -> Column:
    """One token's part of a document's score."""
    idf = F.log(F.lit(1.0) + (F.lit(float(docs)) - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / F.lit(mean)))


def search(queries: DataFrame, index: Index, k: int, *, query_id: str = "item_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rnk): the ``k`` most relevant documents of every query (ties: the smaller id).

    Every distinct token of a query counts once; documents without any of them aren't found.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).distinct()
    small = estimated_bytes(asked) <= BROADCAST_MAX_BYTES
    hint = F.broadcast if small else (lambda df: df)
    only = hint(asked.select("token").distinct())                       # a row for each token of the batch at most
    weighted = asked.join(index.weights.join(only, "token", "left_semi"), "token")
    found = index.postings.join(only, "token", "left_semi").join(hint(weighted), "token")
    scores = found.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(part_score(F.col("tf"), F.col("df"), F.col("n_tokens"), index.docs, index.mean_tokens)), DIGITS).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scores.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
