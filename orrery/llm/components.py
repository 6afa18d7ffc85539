"""Connected components of a graph of any size, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the least node that it reaches.

    Alternates large-star and small-star steps until every node has one edge, to a node without edges of its own; no step
    holds the neighbours of a node together. Loops, nulls and repeated edges are allowed.
    """
    now = scratch.table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    at = 0
    while not is_forest_of_stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b").where("a <> b").distinct()
        at += 1
        now = scratch.table(small, f"{name}{at}")
        scratch.drop(f"{name}{at - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select("b", "b").distinct())


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each greater end has one edge and no lesser end is the greater end of another."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    of = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.where("up > 1 or (up > 0 and down > 0)").isEmpty()
