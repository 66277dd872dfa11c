"""Connected components by alternating large-star and small-star passes over written edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_skewed, materialize


def _stars(edges: DataFrame, count: int, large: bool) -> DataFrame:
    """One pass over (u, v): every node's (large: larger) neighbours, else itself, hang on the least of its neighbourhood."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    joined = join_skewed(pairs, least, "u", "n", 2 * count)  # the middle of a star has all its edges
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of ``edges`` (u, v) can reach, for nodes with an edge.

    Edges are longs in any direction and may repeat.  Every pass writes its
    edges to the shared folder; passes go on until the edge set stays the same,
    after some log² of the nodes.
    """
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = materialize(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, last = digest(now), None
    while mark[0] and mark != last:
        last = mark
        wide = materialize(_stars(now, mark[0], True), "edges")
        now = materialize(_stars(wide, mark[0], False), "edges")
        mark = digest(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
