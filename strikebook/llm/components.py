"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikebook.llm.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connects the larger (large) or the smaller neighbours of each node, and itself, to its least neighbour."""
    both = edges.select(F.col("u"), F.col("v"))
    if large:
        both = both.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("w", "m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:
        pairs = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """From rows (u, v): rows (node, component), where component is the least node reachable.

    Every round is written to the shared folder. It ends when a round changes no edge. Nodes without an
    edge to another node are not listed.
    """
    now = written(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        now = written(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
