"""Scans of stored batches and tables.

All filters are plain column predicates, so Catalyst pushes them into the
Parquet scan (``PushedFilters``) and prunes partitions when the table is
partitioned by the filtered column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from feedsift.operators.common import bounded_broadcast, is_missing_path
from feedsift.operators.dedup import latest_per_key


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """Read a stored batch with a fixed schema; a missing path is an empty batch."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return spark.createDataFrame([], schema)


def lookback(df: DataFrame, day: str, run_date, days: int = 30) -> DataFrame:
    """The ``days`` daily partitions ``D-days+1 .. D`` (inclusive of the run date)."""
    d = F.to_date(_lit(run_date))
    return df.where((F.col(day) > F.date_sub(d, days)) & (F.col(day) <= d))


def rated_since(df: DataFrame, source: str, since, *, edited: str = "last_edited_time",
                rating: str = "user_rating", require_rating: bool = True) -> DataFrame:
    """S3: ``source = s AND edited >= t [AND rated]``; rating cast to INT at the boundary (trap Q5)."""
    cond = (F.col("source") == source) & (F.col(edited) >= _lit(since))
    if require_rating:
        cond = cond & F.col(rating).isNotNull() & (F.col(rating) != "")
    return df.where(cond).withColumn(rating, F.col(rating).cast("int"))


def created_since(df: DataFrame, since, *, strict: bool, created: str = "created_time",
                  edited_after=None, edited: str = "last_edited_time") -> DataFrame:
    """S4 (inclusive ``>=``) and S5 (strict ``>``) inbox scans, optionally also edited after t2."""
    c = F.col(created) > _lit(since) if strict else F.col(created) >= _lit(since)
    if edited_after is not None:
        c = c & (F.col(edited) > _lit(edited_after))
    return df.where(c)


def enabled(df: DataFrame, flag: str = "enabled") -> DataFrame:
    """Enabled subscriptions."""
    return df.where(F.col(flag))


def latest_partitions(partitions: DataFrame, n: int, *, key: str = "partition_id",
                      created: str = "created_time") -> DataFrame:
    """The newest ``n`` partitions (ties by id).

    ``orderBy().limit(n)`` plans as a per-partition top-n merged on one node
    (``TakeOrderedAndProject``), never a single-partition window.
    """
    return partitions.orderBy(F.col(created).desc(), F.col(key).desc()).limit(n)


def restrict_to_partitions(data: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Semi join of the data to the chosen partitions (broadcast after a size check)."""
    return data.join(bounded_broadcast(chosen.select(key)), key, "left_semi")


def head_per_group(df: DataFrame, group: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group.

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle, so a hot group sends at most ``n`` rows per map partition.
    """
    g = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*g).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sync_rated(df: DataFrame, *, key: str = "id", edited: str = "last_edited_time", arrival: str = "arrival",
               rating: str = "user_rating") -> DataFrame:
    """Drop unrated rows, keep the newest version per id."""
    rated = df.where(F.col(rating).isNotNull() & (F.col(rating) != ""))
    return latest_per_key(rated, key, edited, arrival)


def lookup_index(df: DataFrame, index: DataFrame, category: Column, name: Column, out: str = "index_id") -> DataFrame:
    """(category, name) -> id from the index table; missing -> ''."""
    idx = bounded_broadcast(index.select(F.col("category").alias("_cat"), F.col("name").alias("_name"),
                                         F.col("index_id").alias("_id")))
    j = df.join(idx, (category == F.col("_cat")) & (name == F.col("_name")), "left")
    return j.select(*[df[c] for c in df.columns], F.coalesce(F.col("_id"), F.lit("")).alias(out))


def read_texts(spark: SparkSession, expected: DataFrame, folder: str, name_col: str = "name") -> DataFrame:
    """Whole text of ``folder/<name>`` for each expected name; a missing file -> ''."""
    try:
        files = (spark.read.text(folder, wholetext=True)
                 .select(F.col("_metadata.file_name").alias("_fname"), F.col("value").alias("_text")))
    except AnalysisException as e:
        if not is_missing_path(e):
            raise
        return expected.withColumn("text", F.lit(""))
    j = expected.join(files, expected[name_col] == files["_fname"], "left")
    return j.select(*[expected[c] for c in expected.columns], F.coalesce(F.col("_text"), F.lit("")).alias("text"))


def list_members(subscriptions: DataFrame, lists: str = "list_names", member: str = "member") -> DataFrame:
    """The members of each list, a row per (list, member)."""
    return subscriptions.select(F.explode(lists).alias("list_name"), member).distinct()


def members_per_list(subscriptions: DataFrame, lists: str = "list_names", member: str = "member") -> DataFrame:
    """Members per list as rows keyed by list (explode), with the distinct member count per list."""
    s = subscriptions.select(member, F.explode(lists).alias("list_name"))
    return s.groupBy("list_name").agg(F.count_distinct(member).alias("n_members"))
