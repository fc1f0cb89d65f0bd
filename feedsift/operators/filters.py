"""Score filters and gates (F1-F16).

All are column predicates or ``orderBy().limit()`` (planned as
``TakeOrderedAndProject``: a per-partition top-k merged on one node, so only
``k * partitions`` rows move).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedsift.functions.text import INVALID_RESPONSES, strip
from feedsift.operators.common import bounded_broadcast
from feedsift.settings import DEFAULT, Settings

# Fixed values:
EXCLUDED_SOURCES = ["TODO", "Journal"]
DEEPDIVE_TAG = "action:deepdive"
EXCLUDED_SITES = ["twitch.tv"]


def passes_min(score: Column, min_score) -> Column:
    """Unknown (negative) scores pass (cold start, trap Q1); otherwise ``score >= min``."""
    m = min_score if isinstance(min_score, Column) else F.lit(min_score)
    return (score < 0) | (score >= m)


def relevance_topk(df: DataFrame, score: str, tiebreak: str, *, k: int, min_score: float) -> DataFrame:
    """Keep ``score < 0 or score >= min``, highest scores first, first k (ties by id)."""
    return (df.where(passes_min(F.col(score), min_score))
            .orderBy(F.col(score).desc(), F.col(tiebreak).asc()).limit(k))


def parse_overrides(spark: SparkSession, spec: str) -> DataFrame:
    """``"list:min,list2:min2"`` -> (list_name, min_score); entries without ``:`` skipped.

    The spec is configuration (a handful of entries), so it becomes a small
    local DataFrame that is broadcast by size.
    """
    rows = []
    for part in (spec or "").split(","):
        bits = part.split(":")
        if part and len(bits) >= 2:
            rows.append((bits[0], float(bits[1])))
    return spark.createDataFrame(rows, "list_name STRING, min_score DOUBLE")


def with_list_min(df: DataFrame, overrides: DataFrame, *, list_col: str = "list_name",
                  default: float = DEFAULT.min_score, out: str = "min_score") -> DataFrame:
    """Attach ``min = override or default`` per row (an override of 0 falls back, trap Q4)."""
    o = bounded_broadcast(overrides.select(F.col("list_name").alias("_l"), F.col("min_score").alias("_m")))
    j = df.join(o, df[list_col] == o["_l"], "left")
    return j.select(*[df[c] for c in df.columns],
                    F.coalesce(F.nullif(F.col("_m"), F.lit(0.0)), F.lit(default)).alias(out))


def per_list_threshold(df: DataFrame, overrides: DataFrame, *, list_col: str = "list_name",
                       score: str = "relevant_score", default: float = DEFAULT.min_score) -> DataFrame:
    """keep rows passing their list's minimum."""
    j = with_list_min(df, overrides, list_col=list_col, default=default, out="_min")
    return j.where(passes_min(F.col(score), F.col("_min"))).drop("_min")


def digest_prefilter(df: DataFrame, rating: str = "user_rating", take_aways: str = "take_aways",
                     min_rating: int = 4) -> DataFrame:
    """rating >= 4 (as INT, trap Q5) or non-empty take-aways."""
    return df.where((F.col(rating).cast("int") >= min_rating) | (F.coalesce(F.col(take_aways), F.lit("")) != ""))


def sorting_score(rating: Column, relevant: Column, settings: Settings = DEFAULT) -> Column:
    """``0.8 * user_rating + 0.2 * relevant_score``."""
    return rating.cast("double") * settings.digest_rating_weight + relevant.cast("double") * settings.digest_relevance_weight


def digest_postfilter(df: DataFrame, *, rating: str = "user_rating", relevant: str = "relevant_score",
                      tiebreak: str = "id", settings: Settings = DEFAULT) -> DataFrame:
    """Keep sorting score >= 4.5, order by the **relevant** score (trap Q2), first 10."""
    s = df.withColumn("sorting_score", sorting_score(F.col(rating), F.col(relevant), settings))
    return (s.where(F.col("sorting_score") >= settings.digest_min_sorting)
            .orderBy(F.col(relevant).desc(), F.col(tiebreak).asc()).limit(settings.digest_top_k))


def takeaway_pages(df: DataFrame, take_aways: str = "take_aways") -> DataFrame:
    """pages with non-empty take-aways; the take-aways become ``content``."""
    return df.where(F.length(F.coalesce(F.col(take_aways), F.lit(""))) > 0).withColumn("content", F.col(take_aways))


def rating_floor_counts(df: DataFrame, rating: str = "user_rating", floor: int = 4) -> DataFrame:
    """kept (rating >= 4) and skipped counts in one pass."""
    r = F.col(rating).cast("int")
    return df.agg(F.count_if(r >= floor).alias("kept"), F.count_if(~(r >= floor) | r.isNull()).alias("skipped"))


def exclude_source_tag(df: DataFrame, *, sources=None, tag: str = DEEPDIVE_TAG) -> DataFrame:
    """F8: drop excluded sources and pages tagged for a deep dive."""
    src = list(sources or EXCLUDED_SOURCES)
    return df.where(~F.col("source").isin(*src) & ~F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def include_tag(df: DataFrame, tag: str = DEEPDIVE_TAG) -> DataFrame:
    """keep pages carrying the tag."""
    return df.where(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def is_invalid_response(text: Column) -> Column:
    """blank or one of the 'nothing' answers."""
    s = strip(text)
    return text.isNull() | (s == "") | s.isin(*INVALID_RESPONSES)


def rank_gate(score: Column, content: Column, *, enabled: bool = True, settings: Settings = DEFAULT) -> Column:
    """True -> skip the model: low score (0 < s < 4), ranking disabled or, where ``rank_gate_max_chars`` is set,
    longer content (off by default)."""
    low = F.coalesce((score > 0) & (score < settings.rank_gate_low), F.lit(False))   # a missing score is not low
    most = settings.rank_gate_max_chars
    long_ = F.lit(False) if most is None else F.coalesce(F.length(content) > most, F.lit(False))
    return F.lit(not enabled) | low | long_


def summary_action(text: Column, cached: Column, settings: Settings = DEFAULT) -> Column:
    """'cached' when a cache hit exists, 'drop' for empty text, 'pass' up to ``summary_gate_chars``
    (0: none passes), else 'summarise'."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(cached, F.lit("cached"))
            .when(t == "", F.lit("drop"))
            .when(F.length(t) <= settings.summary_gate_chars, F.lit("pass"))
            .otherwise(F.lit("summarise")))


def recent_topk(df: DataFrame, group: str, published: str, score: str, tiebreak: str, *, now, days: int,
                k: int) -> DataFrame:
    """rows published within ``days`` of now, the k most relevant per group."""
    from feedsift.sources.scans import head_per_group

    n = now if isinstance(now, Column) else F.lit(now)
    recent = df.where(F.col(published) >= n - F.make_dt_interval(days=F.lit(days)))
    return head_per_group(recent, group, [F.col(score).desc(), F.col(tiebreak).asc()], k)


def exclude_site(url: Column, sites=None) -> Column:
    """F16: '' when the url contains a blocked host, else the url."""
    cond = F.lit(False)
    for s in (sites or EXCLUDED_SITES):
        cond = cond | F.contains(url, F.lit(s))
    return F.when(cond, F.lit("")).otherwise(url)


# Digest periods.
PERIODS = ["weekly", "monthly", "yearly"]


def period_start(now, period: str) -> Column:
    """R8/trap Q13 (fixed): start of the digest look-back: 7 days, one month or one year before ``now``."""
    n = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    if period == "weekly":
        return n - F.make_dt_interval(days=F.lit(7))
    if period == "monthly":
        return n - F.make_ym_interval(months=F.lit(1))
    if period == "yearly":
        return n - F.make_ym_interval(years=F.lit(1))
    raise ValueError(f"unknown period {period!r}; expected one of {PERIODS}")
