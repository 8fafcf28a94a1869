"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _neighbours(links: DataFrame) -> DataFrame:
    both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
    return both.select("e.u", "e.v")


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Every neighbour that ``keep`` names is tied to the smallest one of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
    tied = pairs.join(least, F.col("u") == F.col("__u")).filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter("u != v")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of the links ``(u, v)``: the smallest node it is connected to.

    Large and small stars in turn (Kiveris and others, 2014) until nothing changes; each pass joins a node's links
    with its one smallest neighbour, so a node with many links may be split over tasks. Passes are stored; only
    a count and a checksum of the links reach the driver.
    """
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        large = _star(_neighbours(edges), F.col("v") > F.col("u")).distinct()
        # small star: links lead down, and u itself is tied to the smallest as well
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), "m")
        small = down.join(least, F.col("u") == F.col("__u")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        edges = stored(small.select("e.u", "e.v").filter("u != v").distinct(), "links")
