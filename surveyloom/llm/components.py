"""Connected components of a graph of long ids, by alternating star steps on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the node's least neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "c")
    return both.where("b > a").join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    moved = down.join(least, F.col("a") == F.col("c")).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))


def _unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that hang from two others, or from one that hangs from another itself."""
    double = edges.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo < hi").select("a")
    tops = edges.select(F.col("b").alias("top")).distinct()
    return double.union(edges.join(tops, F.col("a") == F.col("top"), "left_semi").select("a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the least node of its component. Roots themselves are not listed."""
    current = edges.select("a", "b").where("a != b")
    while True:
        current = materialize(_small_star(_large_star(current)).distinct(), "components")
        if _unsettled(current).isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
