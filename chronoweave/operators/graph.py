"""Connected components by contraction in random order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (u, v): rows (node, component).

    Each round every node takes the neighbour (or itself) that comes first in a
    fresh hash order, and nodes that took the same one become one. The expected
    number of nodes falls by a constant factor a round, chains included, so it
    ends after O(log n) rounds. Choosing is a minimum, combined before the
    shuffle, so a star of any size is no group in one task. Every round is cut
    off by a checkpoint.

    Self-loops and repeated edges are harmless; null ends are left out; the
    component's name is some node of it; no edges give no rows.
    """
    live = checkpointed(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct())
    names = checkpointed(live.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")))
    round_no = 0
    while not live.isEmpty():

        def rank(c: str, seed: int = round_no) -> Column:
            return F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("to"))

        both = live.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        took = checkpointed(both.groupBy("u").agg(F.min(rank("v")).alias("best")).select("u", F.least(F.col("best"), rank("u"))["to"].alias("to")))
        names = checkpointed(names.join(took.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        left = took.select("u", F.col("to").alias("a"))
        right = took.select(F.col("u").alias("v"), F.col("to").alias("b"))
        live = checkpointed(live.join(left, "u").join(right, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct())
        round_no += 1
    return names
