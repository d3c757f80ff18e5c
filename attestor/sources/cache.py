"""Scores kept by content, so that the same content is scored once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(content: Column, fallback: Column) -> Column:
    """sha256 of a file's bytes, else the document's id."""
    return F.coalesce(F.sha2(content, 256), fallback.cast("string"))


def scored(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with their scores: those whose keys the table at path has not are
    scored and added to it first, as a folder of their own. Of two runs at
    once both may score a key; they then have equal scores, one of which is
    read."""
    known = _kept(spark, path)
    new = rows if known is None else rows.join(known.select(*keys), keys, "left_anti")
    score(new.dropDuplicates(keys)).write.parquet(f"{path}/{uuid.uuid4().hex}")
    kept = _kept(spark, path)
    extra = [c for c in kept.columns if c in keys or c not in rows.columns]
    return rows.join(kept.select(*extra).dropDuplicates(keys), keys, "left")


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    """All folders that are complete."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    done = [f.getPath() for f in fs.listStatus(root) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(*(p.toString() for p in done)) if done else None
