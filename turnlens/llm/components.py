"""Connected components of an edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import cut, drop


def components(edges: DataFrame, tries: int = 40) -> DataFrame:
    """``edges`` (a, b) of one ordered type; returns (node, root), root being the smallest node reachable.

    Only nodes that occur in an edge are returned. Each round is written to the shared folder and
    replaces the one before; rounds end when the stars no longer change.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    mark = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = mark(now)
    for _ in range(tries):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), "m").where("u <> m")
        after = cut(small.select("u", F.col("m").alias("v")).distinct(), "star")
        drop(now)
        now, last = after, before
        before = mark(now)
        if tuple(last) == tuple(before):
            break
    else:
        raise RuntimeError(f"components did not settle in {tries} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
