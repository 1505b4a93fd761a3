"""Connected components by alternating stars, as joins and pre-aggregated minima over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge (u, v): the smallest node it reaches. Loops are ignored."""
    now = stored(edges.where("u <> v").select("u", "v").distinct(), "edges")
    sign = None
    while True:
        new = stored(_small_star(_large_star(now)), "edges")
        row = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum("v")).first()
        dropped(now)
        now = new
        if tuple(row) == sign:
            break
        sign = tuple(row)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = stored(nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    dropped(now)
    return out
