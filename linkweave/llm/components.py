"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _unfinished(edges: DataFrame) -> int:
    """Nodes with two roots, or with a root and nodes of their own: none once all components are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("under")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("under")))
    each = ends.groupBy("node").agg(F.sum("under").alias("under"), F.min("under").alias("least"))
    return each.where((F.col("under") > 1) | ((F.col("under") > 0) & (F.col("least") == 0))).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (a, b: long) with the smallest node it reaches.

    Each step relinks neighbours to the smallest one known, so that components turn
    into stars after a number of steps logarithmic in their size. Each step is written
    to the shared folder; the driver only sees a count. Null ends and
    loops are left out. Returns (node, component), one row for each node with an edge.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = written(pairs, "edges")
    while _unfinished(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(moved.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(current)
        current = after
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
