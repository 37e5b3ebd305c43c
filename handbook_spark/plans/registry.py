"""Registry of named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from handbook_spark.corpus import Corpus, with_views

# Positions of one part of a handbook record.
PART_POSITIONS = 10_000

_QUERIES: dict[str, Callable[[Corpus], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan builder; ``sql`` is the DuckDB text with the same rows, views included by name."""

    def register(build: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = build
        if sql is not None:
            _CHECKS[name] = sql
        return build

    return register


def _load() -> None:
    from handbook_spark.plans import (  # noqa: F401  (import registers the queries)
        aggregating, exporting, filtering, joining, mutating, ranking, scalars, scanning, sequencing, traversing,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, sf_dir: build(Corpus(spark, sf_dir))

    return {name: bind(build) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: with_views(sql) for name, sql in _CHECKS.items()}
