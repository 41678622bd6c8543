"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.session import write_scratch


def connected_components(links: DataFrame, node: str = "node", component: str = "component") -> DataFrame:
    """(node, smallest node it can reach) for every node of ``links`` (a, b bigint).

    Alternates two steps until nothing changes: each node passes its smallest neighbour
    to its larger neighbours, then to its smaller ones.  A step is one aggregation and
    one join, and links never grow in number.  Every step is written to the shared
    folder, so that a lost executor costs one step at most.  Loops and repeated links
    are allowed; no links give no rows.
    """
    def step(edges: DataFrame, large: bool) -> DataFrame:
        # each link under its node whose neighbours get the smallest one
        if large:
            sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        passed = sides.filter(F.col("b") > F.col("a")) if large else sides
        moved = passed.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    edges = write_scratch(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    seen = None
    while True:
        edges = write_scratch(step(step(edges, True), False))
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
        if state == seen:
            break
        seen = state
    reached = edges.groupBy(F.col("a").alias(node)).agg(F.min("b").alias(component))
    return reached.unionByName(edges.select(F.col("b").alias(node), F.col("b").alias(component)).distinct())
