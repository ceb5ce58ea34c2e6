"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import stage


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` but the roots themselves.

    The root is the least node of its component. A node's neighbours only meet
    in a minimum that is taken map-side first, and in a join that can be split
    when skewed; no component is gathered. Rounds grow with the logarithm of
    the graph. An empty edge table gives an empty result.
    """
    current, before = stage(_oriented(edges.where("u != v")).distinct(), "edges"), None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.union(near).distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
