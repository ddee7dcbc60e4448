"""Connected components by alternating stars, in a number of rounds logarithmic in the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsgraph.llm.common import cut, drop_cut


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Rows have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.union(least).toDF("u", "v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots: root is the smallest node reachable.

    ``links`` has two id columns; direction, repeats, loops and nulls do not matter. A node
    with any number of links is folded by aggregation, never gathered. Each round is written
    to the shared folder and the one before deleted.
    """
    a, b = links.columns
    edges = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
        .toDF("u", "v", "whole").where("whole and u > v").select("u", "v").distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        new = cut(_small_star(_large_star(edges)))
        drop_cut(edges)
        edges, before = new, mark
        mark = _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
