"""Shared tables, session settings and connected components for the text operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.session import scratch_dir

__all__ = ["components", "load", "materialize", "partitions", "ship", "text_bytes"]


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: several readers, one computation, no lost blocks."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send a module's functions with the job: workers need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    """Width of a shuffle, as the session sets it for its cluster and data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; none for null."""
    return F.coalesce(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), F.lit(b""))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node it reaches.

    Alternates the large-star and small-star steps: each step re-hangs links
    under the smallest known neighbour, so their number never grows and a few
    rounds are enough.  Each round is one written table, no row is gathered,
    and the driver sees only three sums per round.
    """
    edges = materialize(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        centers = edges.select(F.col("v").alias("u")).distinct().withColumn("center", F.lit(1))
        per_node = edges.groupBy("u").agg(F.count("*").alias("n")).join(centers, "u", "left")
        n, nodes, chained = per_node.agg(F.sum("n"), F.count("*"), F.count("center")).first()
        if not n or (n == nodes and not chained):  # stars only: every node hangs directly under its center
            break
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u")
        edges = materialize(
            small.select("u", F.col("m").alias("v"))
            .union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "links")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v"), F.col("v"))).distinct())
