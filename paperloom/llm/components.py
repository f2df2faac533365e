"""Connected components of an edge table by repeated hooking and jumping, each round one written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has two bigint columns.  Every edge points to the smaller end; a node with several targets hooks the
    larger ones to the least, then every target is replaced by its own target.  The number of rows never grows, and
    chains halve in each round.  Repeated edges, loops and an empty table are fine; edges with a null end are ignored.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("to")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("node") != F.col("to"))
    )
    pairs = cut_lineage(pairs.distinct())
    for _ in range(most_rounds):
        # written, so that the joins with it are split where many nodes share a target
        best = cut_lineage(pairs.groupBy("node").agg(F.min("to").alias("least"), F.count("*").alias("n")))
        hooks = (
            pairs.join(best.filter("n > 1"), "node").filter("to <> least")
            .select(F.col("to").alias("node"), F.col("least").alias("to"), F.lit(1).alias("moved"))
        )
        up = best.select(F.col("node").alias("least"), F.col("least").alias("above"))
        jumped = best.select("node", "least").join(up, "least", "left").select(
            "node", F.coalesce("above", "least").alias("to"), F.when(F.col("above").isNull(), 0).otherwise(1).alias("moved")
        )
        grown = cut_lineage(jumped.unionByName(hooks).groupBy("node", "to").agg(F.max("moved").alias("moved")))
        pairs = grown.select("node", "to")
        if grown.filter("moved = 1").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("to").alias("node")).distinct()
    return pairs.select("node", F.col("to").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
