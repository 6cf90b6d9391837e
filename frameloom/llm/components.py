"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Each
step is one aggregation and one join on a node; the aggregated side has one row per
node, so a hub with very many links is a skewed *streamed* side, which adaptive
execution splits.  No adjacency list is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def _star(links: DataFrame, both: bool) -> DataFrame:
    """links (u > v). Large star (both=True) links larger neighbours to the least one; small star the smaller ones."""
    arcs = links.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if both:
        arcs = arcs.unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = arcs.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
    near = arcs.join(least, "x")
    if both:
        out = near.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the least node reachable.

    links has long columns u and v, in any direction, with repeats or loops allowed.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        after = stored(_star(_star(now, True), False), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
