"""Per-stage statistics (A3, A4, A9, A11) computed in one pass each.

The reference counts each stage with its own loop; here every stage is a
boolean column on one DataFrame and a single ``groupBy().agg(count_if ...)``
produces all counters, then ``stack`` turns them into the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Stage counter names and rate-histogram buckets (upper bounds, inclusive).
STAGES = ["total_input", "post_deduping", "post_scoring", "post_filtering", "post_summary", "post_ranking",
          "total_pushed"]
RATE_BUCKETS = [("below_0.5", 0.5), ("below_0.6", 0.6), ("below_0.7", 0.7), ("below_0.8", 0.8),
                ("below_0.9", 0.9), ("below_1", 1.0)]


def funnel_counts(df: DataFrame, by: list[str], flags: dict[str, Column]) -> DataFrame:
    """A3: ``flags`` maps stage name -> boolean column; returns (by..., stage, n) in long form."""
    agg = df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in flags.items()])
    pairs = ", ".join(f"'{n}', `{n}`" for n in flags)
    return agg.select(*by, F.expr(f"stack({len(flags)}, {pairs}) AS (stage, n)")).withColumn("n", F.col("n").cast("bigint"))


def observed_funnel(df: DataFrame, by: str, groups: list[str], flags: dict[str, Column], name: str = "funnel") -> tuple[DataFrame, Observation]:
    """A3 without an action of its own: ``df`` with an observation that counts every stage of every known group while an
    action (a write) reads its rows. ``groups`` is the job's list of sources or lists, so the counters are a bounded number."""
    metrics = [F.count_if((F.col(by) == g) & c).alias(f"{stage}|{g}") for g in groups for stage, c in flags.items()]
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def funnel_of(seen: Observation) -> list[tuple[str, str, int]]:
    """(group, stage, n) of an observation whose action has ended."""
    out = [(*reversed(key.split("|", 1)), n) for key, n in seen.get.items() if "|" in key]
    return [(g, stage, n) for g, stage, n in out]


def rate_bucket(rate: Column) -> Column:
    """A4: first bucket whose upper bound holds the rate; rates above 1 -> NULL (uncounted)."""
    out = F.lit(None).cast("string")
    for name, ub in reversed(RATE_BUCKETS):
        out = F.when(rate <= ub, F.lit(name)).otherwise(out)
    return out


def rate_histogram(df: DataFrame, by: list[str], rate: str = "rate") -> DataFrame:
    """A4: counts per (group, bucket); negative sentinels land in ``below_0.5`` (trap Q26)."""
    b = df.withColumn("bucket", rate_bucket(F.col(rate))).where(F.col("bucket").isNotNull())
    return b.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("n"))


def publish_tallies(df: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """``total`` (attempted, failures included, trap Q12) and ``error`` per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"),
                               F.count_if(F.col(error).isNotNull()).alias("error"))


def collection_stats(vectors: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """Rows per (model, as_of) collection; with the list of ``collections`` also those without any row."""
    n = vectors.groupBy("model", "as_of").agg(F.count(F.lit(1)).alias("n_rows"))
    if collections is not None:
        n = collections.select("model", "as_of").distinct().join(n, ["model", "as_of"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return n.withColumn("is_empty", F.col("n_rows") == 0)
