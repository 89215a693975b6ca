"""Connected components of a distributed edge list by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): ``comp`` is the smallest node it is connected with.

    Each step links a node's neighbours to the smallest of them (the node's lower neighbours to their minimum, then its
    links to the minimum of the other end), until all edges are stars around minima. A hub's edges are the many side
    of a join on one row, which the planner can split. Self links and repeats do not matter; nulls are dropped.
    """
    links = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    while True:
        lowest = links.groupBy("hi").agg(F.min("lo").alias("low"), F.count("*").alias("n"))
        loose = lowest.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"] > 1
        roots = lowest.select(F.col("hi").alias("mid"), F.col("low").alias("root"))
        if not loose and links.join(roots, links["lo"] == roots["mid"], "left_semi").isEmpty():
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(
                links.select("lo", "lo").distinct()
            )
        joined = links.join(lowest.select("hi", "low"), "hi")
        small = joined.select("hi", F.col("low").alias("lo")).union(
            joined.where("lo > low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        ).distinct()
        ends = small.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "mid")
        large = (
            small.join(ends, small["lo"] == ends["mid"], "left")
            .select("hi", F.coalesce("root", "lo").alias("lo"))
            .distinct()
        )
        links = staged(large, "links")
