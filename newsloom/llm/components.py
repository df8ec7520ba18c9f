"""Connected components of a graph given as a DataFrame of edges, without bringing any of it to the driver.

Two steps alternate until nothing changes. Large star: every node's greater neighbours are linked to the least node
around it. Small star: every node and its lesser neighbours are linked to the least of them. Neither connects what was
apart nor parts what was connected, and the number of steps grows with the logarithm of the longest path, not with its
length. Each step's edges are written and read back, so a plan never holds more than one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import saved


def large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each node's neighbours above it go to the least of the node and its neighbours."""
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each node and its neighbours below it go to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.withColumnRenamed("least", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node that is connected.

    Nodes may be of any type with an order. Loops and repeated edges do no harm (a node with loops only is its own
    component); an empty graph has no nodes. There is no limit of rounds.
    """

    def summed(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())

    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was, mark = None, summed(now)
    while mark != was:
        was = mark
        now = saved(small_star(saved(large_star(now))))
        mark = summed(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
    return found.unionByName(loops.join(found, "node", "left_anti").distinct())
