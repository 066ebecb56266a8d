"""Connected components of a distributed edge list by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.common import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge.

    ``edges`` has columns a and b.  Every round links each node's larger
    neighbours, then its smaller ones, to the smallest node of its
    neighbourhood; the rounds end when no edge changes, after a number that
    grows with the logarithm of the longest path.  Each half of a round is written
    to the shared folder, so a lost executor never costs more than it, and a plan has
    one join and no broadcast: the driver starts a thread for each exchange or broadcast
    of a plan, and all of them in a minute add up in its memory.  Minima
    are aggregates, combined on the map side, so a hub of any degree is no
    more than a row per task before the shuffle.  An empty edge list gives no rows.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")).hint("merge")
        out = both.join(least, "a")
        if large:
            out = out.where("b > a").select("m", F.col("b").alias("x"))
        else:  # beside b its node itself is linked with m
            out = out.where("b <= a").select("m", F.explode(F.array("a", "b")).alias("x"))
        return out.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()

    now = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    mark, k = None, 0
    while True:
        k += 1
        half = scratch.write(star(now, True), f"half{k}")
        scratch.drop(f"edges{k - 1}")
        seen = Observation()  # of the edges, as they are written
        now = scratch.write(star(half, False).observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a")).alias("y")), f"edges{k}")
        scratch.drop(f"half{k}")
        if seen.get["n"] == 0 or seen.get == mark:
            break
        mark = seen.get
    child = now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return child.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
