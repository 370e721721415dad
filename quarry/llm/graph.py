"""Connected components by alternating large and small stars, each iteration written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def _down(e: DataFrame) -> DataFrame:
    return e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or bound to one centre only; then the edges are the components."""
    roles = e.select(F.col("u").alias("node"), F.lit(1).alias("bound"), F.lit(0).alias("centre")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("bound"), F.lit(1).alias("centre")))
    return roles.groupBy("node").agg(F.sum("bound").alias("bound"), F.max("centre").alias("centre")).where("bound > 1 or (bound > 0 and centre > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of an undirected edge list (two columns of longs).

    Hubs cost no more than other nodes: minima are partially aggregated, and joins on a hub can be split.
    """
    a, b = links.columns
    e = spool(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = spool(_down(small.select("v", F.col("m")).toDF("u", "v").unionByName(small.select("u", F.col("m").alias("v")))), "edges")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(nodes.select(F.col("label").alias("node"), "label")).groupBy("node").agg(F.min("label").alias("label"))
