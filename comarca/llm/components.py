"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.lineage import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node reachable) for each node that `edges` joins to a smaller one.

    Each round hangs the neighbours of every node on its smallest neighbour, until every node hangs on
    one that hangs on none, which no further round would change: a number of rounds that grows with
    the logarithm of the longest path. Edges stay in tables; a round's result is written to the
    checkpoint folder. Nodes with many edges are aggregated before they are joined. Null ends, loops
    and repeated edges are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(now.filter(F.col("u") != F.col("v")).distinct())
    while _deep(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(root, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(hung.union(root).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _deep(edges: DataFrame) -> int:
    """How many nodes hang on more than one node, or on one and have others hang on them."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0)))).first()[0]
