"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the least node reachable.

    Each round every node moves to its least neighbour, and one step on from
    there; links within one target vanish. A round at least halves what is left,
    so the rounds grow with the logarithm of the longest path. Null ends are ignored.
    """
    edges = stored(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "links")
    placed = stored(edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct().withColumn("label", F.col("node")), "nodes")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least("a", F.min("b")).alias("to"))
        step = to.select(F.col("a").alias("_at"), F.col("to").alias("_on"))
        to = stored(to.join(step, to["to"] == step["_at"]).select("a", F.least("to", "_on").alias("to")), "moves")
        one, two = to.toDF("a", "x"), to.toDF("b", "y")
        placed = stored(
            placed.join(to.toDF("label", "_to"), "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "nodes"
        )
        edges = stored(
            edges.join(one, "a").join(two, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links"
        )
    return placed
