"""Claims as they arrive: each is judged once, however often it comes.

The reference has no streams; this wraps its idempotent stages for claims that
arrive as files. Late duplicates within the watermark are dropped by the
stream's state; beyond it, the anti-join with the verdicts written so far
keeps a repeated batch or claim from being judged again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException


def read_claims(spark: SparkSession, path: str, schema: str, delay: str = "1 hour") -> DataFrame:
    """A stream of claim files, without repeats of a claim within the delay."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["claim_id", "run_id"])


def judge_batch(judge: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A sink that judges the claims of a batch that have no verdict yet."""

    def sink(batch: DataFrame, number: int) -> None:
        try:
            done = batch.sparkSession.read.parquet(out).select("claim_id", "run_id")
            batch = batch.join(done, ["claim_id", "run_id"], "left_anti")
        except AnalysisException:  # no verdicts so far
            pass
        judge(batch.dropDuplicates(["claim_id", "run_id"])).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return sink


def start(claims: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataStreamWriter:
    return claims.writeStream.foreachBatch(judge_batch(judge, out)).option("checkpointLocation", checkpoint)


def status_counts(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Transitions (run_id, status, changed_at) counted by window and status."""
    return events.withWatermark("changed_at", delay).groupBy(F.window("changed_at", window), "status").agg(F.count("*").alias("n"))
