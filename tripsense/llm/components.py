"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripsense.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)`` that is not the smallest of its component.

    Each step links all larger (then smaller) neighbours of a node to its smallest one; edges stay as
    many as they are, nothing is gathered, and a number of steps logarithmic in the component's size
    leaves stars. Every step is checkpointed in the shared folder, and so are the smallest neighbours of the nodes before they
    are joined to the edges: Spark then splits the join where a node (the root of a large component) has many edges.
    """
    star = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        large = materialize(large)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        near = large.join(least, "a")
        small = (near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
                 .filter("a <> b").distinct())
        star = materialize(small)
        now = tuple(star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return star.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
