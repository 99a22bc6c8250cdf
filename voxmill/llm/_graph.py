"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._store import cut, drop


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every end of edges(a, b); component is the smallest id that links reach.

    Edges are rewired by turns (large star, small star) until every vertex points at its root: the number of rounds
    grows with the logarithm of the vertex count.  A hub's edges are never gathered: its smallest neighbour is a partial
    aggregate, and the join that hands it out is between two written tables, so skewed keys are split.  Edges that are
    stars need no round, and none follows the one that makes them so.  Null ends and loops are no edges; an edge table
    without rows gives no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), name)
        large = cut(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        drop(now, least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(small.where("a <> b").distinct(), name)
        drop(large, least)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex points at one other at most, and none that is pointed at points at another."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("b", F.lit(0), F.lit(1)))
    open_ends = ends.groupBy("v").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return open_ends.agg(F.count("*")).first()[0] == 0
