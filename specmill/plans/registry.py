"""Named queries over the driver tables, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def load() -> None:
    from . import (q_devices, q_enrich, q_events, q_facets, q_linkage, q_pages, q_quality, q_records, q_reports,  # noqa: F401
                   q_rules, q_scalars, q_search, q_sources)
