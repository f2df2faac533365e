"""Connected components by large and small stars: every round is two aggregates and two joins, and chains shrink fast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import Steps


def _star(edges: DataFrame, all_neighbours: bool) -> DataFrame:
    """Hang the neighbours of every vertex a (the greater ones, or the smaller ones) on the least of them and itself.

    Edges (a, b) have a > b.
    """
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if all_neighbours else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if all_neighbours:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node of its component.

    ``edges`` has two columns of one orderable type; rounds end when two forests are equal, by their number of edges and
    the sum of their hashes.
    """
    a, b = edges.columns
    steps = Steps(edges.sparkSession)
    now = steps.cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = mark(now)
    while before[0]:
        now = steps.cut(_star(_star(now, True), False))
        after = mark(now)
        if after == before:
            break
        before = after
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return steps.keep(pairs.unionByName(roots))
