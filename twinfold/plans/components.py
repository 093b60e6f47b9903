"""Connected components of an edge table (large-star / small-star, Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settings import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.inline(ends))


def _is_forest(edges: DataFrame) -> bool:
    """Whether every upper end has one root, and no root is an upper end."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return nodes.agg(F.count_if(F.expr("ups > 1 OR ups = 1 AND n > 1"))).first()[0] == 0


def star_forest(edges: DataFrame) -> DataFrame:
    """``u, v`` for every node with an edge that is not the least of its component; ``v`` is the least.

    Each round points nodes at smaller ones until every component is a star, in
    a logarithmic number of rounds. A round is three shuffles: by either end, and to
    drop repeated edges. Each is checkpointed, so a lost executor costs one round.
    """
    least = F.min("v").over(Window.partitionBy("u"))
    current = edges.where("u <> v").select("u", "v")
    while True:
        large = _both_ways(current).withColumn("m", F.least("u", least)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.withColumn("m", least)
        small = low.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        current = cut_lineage(small.where("u <> v").distinct())
        if _is_forest(current):
            return current


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the least node."""
    stars = star_forest(edges)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select("v", "v").distinct())
