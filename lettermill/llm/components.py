"""Connected components of an undirected link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable. links: two columns of one ordered type.

    Self links and nulls are ignored, repeated links count once. Each round is two groupings and joins on the remaining links,
    written to the shared folder; rounds grow with the logarithm of the longest path, and no task or driver holds a component.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, mark = written(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        after = written(_small_star(_large_star(edges)), "links")
        discard(edges)
        edges = after
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
    out._lettermill_path = edges._lettermill_path  # so that the caller can discard it
    return out
