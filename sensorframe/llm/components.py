"""Connected components by contraction to smallest neighbours, over DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges`` (two long columns); label is
    the smallest node reachable. Every round merges each node into its smallest
    neighbour's smallest neighbour and keeps only edges between different
    merged nodes, at most half as many nodes as before. Rounds are written to the
    shared folder, so that lost executors cost one round."""
    left = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "cc-edges")
    whole = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")), "cc-up")
        step = saved(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("label")), "up").select(
            F.col("a").alias("node"), "label"), "cc-step")
        of_a, of_b = (step.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        left = saved(left.join(of_a, "a").join(of_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
                     .filter("a <> b").distinct(), "cc-edges")
        if whole is None:
            whole = step
        else:
            after = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            whole = saved(whole.join(after, "label", "left").select(
                "node", F.coalesce("next", "label").alias("label")), "cc-labels")
        if left.isEmpty():
            return whole
