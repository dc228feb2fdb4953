"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are tied to the smallest of them: its larger ones (large), or itself and its smaller ones."""
    if large:
        seen = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = seen.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of comparable ids: node, component (its smallest node), a row for each node of an edge.

    Rounds of stars until one changes nothing; their number grows with the logarithm of the nodes.
    """
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    summary = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = summary(edges)
    while True:
        edges = checkpointed(star(star(edges, True), False))
        now = summary(edges)
        if now == before:
            break
        before = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
