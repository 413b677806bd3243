"""Connected components of bipartite links by alternating minima with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import discard, durable


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for undirected ``links`` (``a, b``): the smallest node each node is connected with.

    Large-star and small-star steps alternate, so rounds grow with the logarithm of a component's size. Null ends are no
    links; repeated links and self-links are harmless; a hub's links are grouped by minima only, never listed.
    """
    edges = durable(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    edges = durable(edges.where("u <> v"))
    mark = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("m < u")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        new = durable(large.join(down, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if now == mark:
            break
        mark = now
    root = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(root, nodes["node"] == root["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
