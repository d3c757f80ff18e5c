"""What the operators of this subpackage share: tables and connected
components; written tables and code shipping are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.shipping import ship_code  # noqa: F401  the operators take them from here
from attestor.workspace import Workspace, shared_dir  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as two long columns.

    Alternating large-star and small-star rounds; every round's edges are a
    written table, so lineage stays short and a lost executor costs one round.
    Minima are aggregated before the join, so a node with very many neighbours
    is pre-aggregated and its join partition can be split. Returns (node,
    component) for every node with an edge to another; component is the
    smallest node of its component.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = ws.write(clean.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        step = ws.write(large.where("u <> v").distinct(), "large")
        least = step.groupBy("u").agg(F.min("v").alias("m"))
        small = step.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = ws.write(small.distinct(), "small")
        new = _mark(after)
        ws.drop(step)
        ws.drop(now)
        now = after
        if new == mark:
            break
        mark = new
    heads = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.expr("bit_xor(xxhash64(v, u))")).first()
    return tuple(row)
