"""Connected components of a graph given by its edges, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.frames import settle


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node it knows (large star)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    moved = both.join(least, F.col("a") == F.col("c")).where(F.col("b") > F.col("a"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these (small star); edges point from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
    moved = edges.join(least, F.col("a") == F.col("c"))
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("c").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its least node.

    Nodes may be of any ordered type. Every round is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. A hub with many neighbours is a hot key of the joins; the task that
    has it streams its rows where adaptive execution does not split it.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        edges = settle(_small(_stars(edges)), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
