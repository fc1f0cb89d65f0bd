"""feedsift: Spark-native content curation.

Items from feeds are given stable ids, de-duplicated against what was already
seen, scored by the ratings of their nearest rated neighbours, filtered and
ranked, enriched through a read-through cache and published together with
per-stage funnel counts.  Every stage is a ``DataFrame -> DataFrame`` function.
"""

__all__ = ["settings", "session"]
