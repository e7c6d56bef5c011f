"""Registry of the checked queries: name -> (Spark builder, DuckDB SQL or None).

Each query reads whole driver tables from ``sf_dir`` and returns a long-form
DataFrame (no arrays) whose column names match its oracle SQL.  Floats are
rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql=None`` = no exact SQL twin (rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    return out.alias(name if name else (c if isinstance(c, str) else "value"))


def load_all() -> None:
    """Import every query module so the registry is filled."""
    from sslspark.plans import (  # noqa: F401
        q_core, q_prep, q_metrics, q_state, q_imbalance, q_similarity, q_jobs, q_stream, q_sources, q_policies,
    )
