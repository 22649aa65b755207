"""Connected components of a link table by alternating large and small stars, as joins and partial minima.

All joins are shuffle joins at every size: links and components never pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.storage import dealt_anew, written

EDGES_A_TASK = 500_000


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the least node of their end u."""
    return edges.join(dealt_anew(least, "w"), F.col("u") == F.col("w"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour above a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return _joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of them. Edges go from the larger node u to the smaller v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = _joined(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; a component's name is its least node."""
    edges = written(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    n, state = edges.count(), None
    while n:
        stars = _small_star(written(_large_star(edges).coalesce(1 + n // EDGES_A_TASK), "stars"))
        edges = written(stars.coalesce(1 + n // EDGES_A_TASK), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = now[0]
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
