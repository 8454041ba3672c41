"""Connected components by alternating large and small stars, a table per step in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to the least node among them and itself.

    A large star moves the neighbours that are larger than the node, a small one those that are
    smaller, and the node itself.
    """
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    joined = pairs.join(least, "node")
    if large:
        moved = joined.filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("other").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        )
    return moved.filter("a > b").distinct()


def components(links: DataFrame, a: str, b: str, label: str = "components") -> DataFrame:
    """``node, component`` (the least node reachable) for each node that has a link to another one."""
    scratch = Scratch(links.sparkSession, label)
    edges = scratch.save(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "edges-0"
    )
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen, step = state(edges), 0
    while seen[0]:
        step += 1
        edges = scratch.save(_star(_star(edges, True), False), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
