"""Registry of named queries: ``key -> fn(spark, sf_dir) -> DataFrame`` and
the DuckDB SQL that computes the same result (the oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``key`` with an optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from tabsmith.plans import (  # noqa: F401
        q_charts, q_clean, q_ml, q_profile, q_relate, q_rows, q_schema, q_sources, q_sql,
    )
