"""All registered queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.plans import document_queries, event_queries, record_queries, search_queries, store_queries, url_queries  # noqa: F401
from tarn.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_search"](spark, sf_dir)
