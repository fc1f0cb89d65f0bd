"""Shared helpers for fixture queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run parameters of the fixture queries (the test events span 2024-01-01 .. 2024-01-30).
RUN_DATE = "2024-01-20"
RUN_TS = "2024-01-20 00:00:00"
SINCE_TS = "2024-01-10 00:00:00"


def ts(value: str) -> Column:
    """A TIMESTAMP_NTZ literal (the test tables carry time-zone-less timestamps)."""
    return F.lit(value).cast("timestamp_ntz")


def ts_text(col) -> Column:
    """Timestamp rendered with microseconds, identical to DuckDB's ``strftime(.., '%Y-%m-%d %H:%M:%S.%f')``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def duck_ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"
