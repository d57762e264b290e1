"""The operators of this subpackage bound to the driver's tables: ``QUERIES`` and ``ORACLE``."""

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
    from corpuscope.llm import queries_dedup, queries_files, queries_repair, queries_scan  # noqa: F401
    return QUERIES, ORACLE
