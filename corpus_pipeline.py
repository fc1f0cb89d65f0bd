"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and its predecessor's documents, read back
from Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedsift.llm import decontam, line_dedup, packing, simhash, toxicity
from feedsift.llm.common import staged, table, tokenizer_path
from feedsift.session import ensure_importable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model scores under 0.5."""
    ensure_importable(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines on more than a tenth of their source's distinct texts."""
    ensure_importable(spark)
    return line_dedup.drop_lines(docs, host_col="source", ratio=0.1, min_pages=5, copies_once=True)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each SimHash component (three-word shingles, two bits)."""
    ensure_importable(spark)
    return simhash.keep_first(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    ensure_importable(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of 1024."""
    ensure_importable(spark)
    return packing.pack(docs, tokenizer_path(), width=1024, end_id=0).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Hashing, model fitting and tokenising have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
