"""Connected components of a graph whose links stay distributed: large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs, in any direction, repeats and loops allowed -> node, root: each linked node and its component's least node.

    Each round is two aggregations with map-side combining and two joins, written to the shared folder, so neither the
    lineage nor any task holds a component. It ends when a round changes nothing; the number of rounds grows with the
    logarithm of the longest path. Without edges the result is empty.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        now = materialise(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), "small-star", large, now)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
