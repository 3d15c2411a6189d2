"""Registry of named queries: name -> (spark, data directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwatch.sources.business import Business

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str | None = None):
    def register(build: Callable[[Business], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = lambda spark, sf_dir: build(Business(spark, sf_dir))
        return build

    return register
