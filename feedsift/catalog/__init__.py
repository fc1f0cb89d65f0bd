"""Registry of the fixture queries: name -> Spark builder, name -> DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)``, reads the given test tables (through
``feedsift.bind``) and runs the library operator on them.  The oracle is the
same computation written as plain SQL over the same bindings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedsift.bind import with_bindings

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, uses: tuple[str, ...] | list[str] = (), sql: str | None = None, recursive: bool = False):
    """Register a fixture query; ``sql`` (optional) is the oracle body over the ``uses`` bindings."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_bindings(list(uses), sql, recursive)
        return fn

    return deco


_LOADED = False


def load_all() -> None:
    """Import every catalog module so that its queries register (idempotent)."""
    global _LOADED
    if _LOADED:
        return
    import importlib

    for mod in MODULES:
        importlib.import_module(f"feedsift.catalog.{mod}")
    _LOADED = True


MODULES = ["q_scoring", "q_functions", "q_dedup", "q_filters", "q_text", "q_records", "q_jobs", "q_normalise"]
