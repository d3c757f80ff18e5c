"""The shared folder and tables written there, which cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a run in one process (local master) gets a temporary
    folder; on a cluster that is an error, as executors could not see it.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="attestor-")
    return _LOCAL_DIRS[app]


#: While a table is written: shuffle files go when the execution that made
#: them ends, as what is written does not need them any more; and few bytes
#: are handed to Python at a time, as rows may be large.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def _measured(spark: SparkSession) -> dict[str, str]:
    """Settings under which only sides are broadcast whose rows Spark has
    measured while it ran. A file's size is no measure: rows of a compressed
    table may be a hundred times as large, too large for the driver."""
    most, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    return {adaptive: spark.conf.get(adaptive, None) or spark.conf.get(most), most: "-1"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """A new folder of one operator run below the shared folder.

    Tables written here survive lost executors and are read back with fresh
    statistics. Those that nothing reads any more are dropped by the operator;
    the others stay as long as the application, since the returned DataFrames
    read them lazily, and go when it ends.
    """

    def __init__(self, spark: SparkSession, name: str, measured: bool = False):
        """measured: tables are written without broadcasts by file sizes."""
        self.measured = measured
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        self._n += 1
        with _settings(self.spark, _WRITING | (_measured(self.spark) if self.measured else {})):
            return self._write(df, name, partition_by)

    def _write(self, df: DataFrame, name: str, partition_by: tuple[str, ...]) -> DataFrame:
        out, writer = f"{self.path}/{self._n:03d}-{name}", df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def drop(self, df: DataFrame, part: str | None = None) -> None:
        """Remove the files of a table of this workspace that nothing reads
        any more, or of one of its partitions (name=value)."""
        jvm = self.spark.sparkContext._jvm
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if part is not None and os.path.basename(f) != part:
                continue
            path = jvm.org.apache.hadoop.fs.Path(f)
            if f.split(":", 1)[-1].lstrip("/").startswith(self.path.split(":", 1)[-1].lstrip("/")):
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
