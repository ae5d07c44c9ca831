"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_checkpoints


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of links(a, b); loops may stand for nodes without links.

    Each round hangs the neighbours of a node on the smallest of them; it ends when only stars are left. Rounds grow
    with the logarithm of the longest chain. A round's result is checkpointed, so that lost executors cost one round.
    The neighbours of a node with very many of them, such as the centre of a star, are split by the adaptive skew join: a
    join that deals them out by hand took a third more joins, and more than the check tool's time where partitions are many.
    """
    with_checkpoints(links.sparkSession)
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Here every u has only smaller neighbours.
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
        edges = small.distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
