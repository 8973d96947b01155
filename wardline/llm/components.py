"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge a, b.

    Each round hooks every node's larger neighbours, then its smaller ones, to the smallest node it
    knows, which takes about the logarithm of the largest component's size in rounds. Groups are only
    summed up and joined, never gathered. Nodes without edges aren't listed; nulls are left out. More rounds
    than most_rounds raise an error, so that no forest is returned before it is done.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = cut(known.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        hooked = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(20)")).alias("x")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
