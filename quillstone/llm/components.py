"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import through_disk


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: columns a and b (long), in any direction, repeats and loops allowed.

    Gives (node, component) for every node of an edge: component is the smallest node that can be reached.  Each round
    is a grouped minimum and a join with one row a node on one side (which Spark splits when a node has very many
    edges), then written to the shared folder, so the plan stays short and no edges ever reach the driver.  Nodes
    without edges have no row; an edge with a null end is none; an empty list gives no rows.
    """
    now = through_disk(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = through_disk(large.where("u <> v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = through_disk(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        if (then := _state(now)) == state:
            break
        state = then
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """Changes when the edges do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
