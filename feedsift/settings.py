"""Job configuration (X6).  Immutable; read on the driver, never inside executors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Every tunable of the jobs in one frozen object, passed explicitly (no env reads in executors)."""

    # scoring (A1/A2, J5)
    neighbours: int = 2                 # k nearest rated items per scored item
    digest_neighbours: int = 4          # k for the weekly digest (self excluded afterwards)
    metric: str = "L2_SQUARED"          # L2, L2_SQUARED, IP or COSINE
    max_distance: float | None = 0.5
    unknown_score: float = -1.0         # no neighbour -> unknown
    # filters (F1, F2, F5)
    min_score: float = 4.0
    relevance_top_k: int = 1
    digest_min_sorting: float = 4.5
    digest_top_k: int = 10
    digest_rating_weight: float = 0.8
    digest_relevance_weight: float = 0.2
    # enrichment gates
    rank_gate_low: float = 4.0
    rank_gate_max_chars: int | None = None   # a length above which ranking is skipped; off
    summary_gate_chars: int = 0              # texts up to this length pass unsummarised; off
    gated_rate: float = -0.02
    unparsed_rate: float = -0.01
    # labels (P11, T1)
    label_chars: int = 20
    top_labels: int = 3
    # chunking (M1, M2)
    summary_chunk: int = 2048
    summary_overlap: int = 256
    index_chunk: int = 1024
    index_overlap: int = 128
    block_chars: int = 1800
    # state TTLs in seconds
    model_cache_ttl: int = 7 * 24 * 3600
    embedding_ttl: int = 30 * 24 * 3600
    rating_ttl: int = 30 * 24 * 3600
    # look-backs
    lookback_days: int = 30
    retention_days: int = 3
    weekly_days: int = 7
    latest_partitions: int = 2
    # KNN execution
    knn_broadcast_queries: int = 1000   # a batch of at most so many queries is broadcast to the rated side
    knn_block_rows: int = 20000         # about so many vectors of a cell, and queries that look at it, meet in one task
    knn_pivots: int = 1024              # cells of a large join at most (else the square root of the rated rows)


DEFAULT = Settings()
