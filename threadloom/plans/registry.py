"""All registered queries of the core, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans import delivery_queries, search_oracles, search_queries, transcript_queries


def queries() -> dict:
    return {**search_queries.QUERIES, **delivery_queries.QUERIES, **transcript_queries.QUERIES}


def oracles() -> dict[str, str]:
    return {**search_oracles.ORACLES, **delivery_queries.ORACLES, **transcript_queries.ORACLES}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return search_queries.lexical_top(spark, root)
