"""A stored cell index: vectors in Parquet, one folder per cell, with the centroids beside them.

``build`` assigns every vector to its nearest centroid and writes it below ``vectors/cell=<n>``; large cells become several
files.  ``append`` assigns new vectors by the stored centroids and adds their files, without touching what is there; ids that
the index knows already are left out, so an append that is tried again changes nothing.  ``search`` deals the
(query, cell) visits into blocks of neighbouring cells within a fixed budget; a block is broadcast and scans the folders of
its own cells only (partition pruning), unshuffled, so all blocks together read each visited cell about once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import vectors as vec
from paperloom.session import cut_lineage

FILE_BYTES = 128 << 20


def build(corpus: DataFrame, cells: DataFrame, path: str, vector_id: str = "vec_id", embedding: str = "embedding") -> None:
    """Write the index of a corpus under (cell, centroid); an index at the path is replaced."""
    cells.select("cell", "centroid").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    _write(corpus, corpus.sparkSession.read.parquet(f"{path}/cells"), path, vector_id, embedding, "overwrite")


def append(vectors: DataFrame, path: str, vector_id: str = "vec_id", embedding: str = "embedding") -> None:
    """Add the vectors whose ids the index does not hold."""
    spark = vectors.sparkSession
    known = stored(spark, path).select(vector_id)
    _write(vectors.join(known, vector_id, "left_anti"), spark.read.parquet(f"{path}/cells"), path, vector_id, embedding, "append")


def _write(vectors: DataFrame, cells: DataFrame, path: str, vector_id: str, embedding: str, mode: str) -> None:
    rows = vectors.filter(F.size(embedding) > 0).select(vector_id, embedding)
    assigned = vec.nearest_cells(rows, cells, 1, embedding)
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(embedding)), F.lit(0)) * 4).first()
    # as many parts as a cell would need that held all vectors, so a hot cell is written by many tasks
    parts = max(1, -(-size // FILE_BYTES))
    dealt = assigned.repartition("cell", F.pmod(F.xxhash64(vector_id), F.lit(parts)))
    dealt.write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def cell_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(cell, vectors) of every centroid, empty ones included."""
    counts = stored(spark, path).groupBy("cell").agg(F.count("*").alias("vectors"))
    return spark.read.parquet(f"{path}/cells").select("cell").join(counts, "cell", "left").fillna(0, ["vectors"])


def _blocks(visits: DataFrame, budget: int, embedding: str) -> list[tuple[list[int], int, int]]:
    """(cells, part, parts) of every block: neighbouring cells within the budget; the queries of a hot cell in parts of their own.

    One row per cell reaches the driver, and there are as many cells as centroids.
    """
    sizes = visits.groupBy("cell").agg((F.sum(F.size(embedding)) * 8).alias("bytes")).collect()
    out, held, total = [], [], 0
    for r in sorted(sizes, key=lambda r: r["cell"]):
        if r["bytes"] > budget:
            parts = -(-r["bytes"] * 4 // (3 * budget))
            out += [([r["cell"]], p, parts) for p in range(parts)]
            continue
        if total + r["bytes"] > budget:
            out.append((held, 0, 1))
            held, total = [], 0
        held.append(r["cell"])
        total += r["bytes"]
    return out + [(held, 0, 1)] * bool(held)


def pruned(spark: SparkSession, path: str, cells: list[int]) -> DataFrame:
    """The stored vectors of some cells; the filter on the partition column keeps all other folders unread."""
    return stored(spark, path).filter(F.col("cell").isin(cells))


def search(
    queries: DataFrame, path: str, k: int, n_probe: int = 10, query_id: str = "query_id", vector_id: str = "vec_id",
    embedding: str = "embedding", budget: int = vec.QUERY_BYTES,
) -> DataFrame:
    """(query id, vector id, similarity, rank): the k best of the ``n_probe`` nearest cells of every query, scored exactly."""
    spark = queries.sparkSession
    visits = cut_lineage(vec.nearest_cells(queries.filter(F.size(embedding) > 0).select(query_id, embedding), spark.read.parquet(f"{path}/cells"), n_probe, embedding))
    kinds = {**dict(queries.dtypes), **dict(stored(spark, path).dtypes)}
    schema = f"{query_id} {kinds[query_id]}, {vector_id} {kinds[vector_id]}, similarity double"
    local = spark.createDataFrame([], schema)
    for cells, part, parts in _blocks(visits, budget, embedding):
        block = visits.filter(F.col("cell").isin(cells))
        if parts > 1:
            block = block.filter(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part)
        local = local.unionByName(_visit(block, pruned(spark, path, cells), k, query_id, vector_id, embedding, schema))
    return vec._rank(local, k, query_id, vector_id)


def _visit(block: DataFrame, corpus: DataFrame, k: int, qid: str, vid: str, emb: str, schema: str) -> DataFrame:
    """Score a block's queries against the vectors of their cells."""
    rows = block.select("cell", qid, emb).toPandas()  # within the budget, see _blocks
    by_cell = {int(c): (g[qid].to_numpy(), vec._by_length(g[emb])) for c, g in rows.groupby("cell")}
    held = block.sparkSession.sparkContext.broadcast(by_cell)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for pdf in batches:
            for cell, group in pdf.groupby("cell"):
                if int(cell) not in held.value:  # a part of a hot cell that no query fell into
                    continue
                got = vec._score_by_length(held.value[int(cell)][1], group[emb], group[vid].to_numpy(), k)
                if got is not None:
                    best[cell] = got if cell not in best else vec._keep_best(*[np.concatenate(x) for x in zip(best[cell], got)], k)
        for cell, (q, ids, scores) in best.items():
            yield pd.DataFrame({qid: held.value[int(cell)][0][q], vid: ids, "similarity": scores})

    return corpus.select("cell", vid, emb).mapInPandas(run, schema)
