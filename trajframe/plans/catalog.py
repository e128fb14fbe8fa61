"""Query registry: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Query modules register themselves with ``@query(name, sql)``; the driver
entry points (``__spark_entry__.py``) read ``QUERIES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the modules fills QUERIES
    from . import q_compose, q_core, q_match, q_annotate, q_misc  # noqa: F401
    return QUERIES
