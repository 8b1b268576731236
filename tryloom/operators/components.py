"""Connected components by star contraction.

Each round first joins every node's greater neighbours to its least one, then
every node and its lesser neighbours to the least of them. Edges keep what they
connect, paths halve, and at the end every node hangs on the least of its
component. A chain of n nodes takes about log2(n) rounds; a round is two shuffles
and one checkpoint. A node's neighbours are aggregated, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tryloom.sources.shared import settled


def _contracted(edges: DataFrame) -> DataFrame:
    """One round on ``u`` > ``v``."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``part``, the least node of its component, for each node of ``edges`` (``a``, ``b`` of an orderable type).

    An edge with a null end is none; a node that is joined with itself alone is its own component.
    """
    known = settled(edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    pairs = known.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        pairs = settled(_contracted(pairs))
        state = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    nodes = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
