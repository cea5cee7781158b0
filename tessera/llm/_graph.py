"""Connected components of a large edge table, without the edges ever leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._pack import written


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the smallest v of each u, itself included; a hot u is split by the skew join."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that can be reached.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until nothing changes: every node
    then hangs from its component's smallest. The state is written to the shared folder once a round.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _star(large)
        small = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    ends = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
