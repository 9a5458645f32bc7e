"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import discard, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node of its component.  Nodes are
    of any type that has an order.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each an aggregation over
    edges, until nothing changes; every round is written to the shared folder, so the plan doesn't
    grow and lost executors cost one round.  Edges with a null end are ignored; loops and repeated
    edges are harmless; no edges give no rows."""
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), name
    )
    before = None
    while True:
        own = Window.partitionBy("a")
        # large star: every larger neighbour of a node points to the node's least neighbour
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.withColumn("m", F.least(F.min("b").over(own), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: every smaller neighbour, and the node, point to the least of them
        small = large.withColumn("m", F.min("b").over(own)).select(F.explode(F.array("b", "a")).alias("a"), F.col("m").alias("b"))
        last, now = now, written(small.where("a <> b").distinct(), name)
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
