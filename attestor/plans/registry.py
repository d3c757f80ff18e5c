"""Queries by name, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType

from attestor.shipping import ship_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name. Whole numbers
    become long, so that types are those of the SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            df = f(spark, sf_dir)
            small = [c.name for c in df.schema if isinstance(c.dataType, (IntegerType, ShortType))]
            return df.withColumns({c: F.col(c).cast("long") for c in small})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
