"""Registered queries: each operator of the inventory bound to the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> DuckDB SQL``.
Every query reads whole tables; every computed column is aliased the same on
both sides; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> tuple[dict, dict]:
    """Import every query module (which fills the registries) and return them."""
    from corpuscope.plans import q_checks, q_keywords, q_misc, q_quality, q_recommend, q_search, q_similarity, q_sinks  # noqa: F401
    return QUERIES, ORACLE
