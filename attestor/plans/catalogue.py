"""All named queries of the reference's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence_queries, review_queries, run_queries, source_queries, text_queries  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their verdicts, best evidence and provenance."""
    return QUERIES["verify"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
