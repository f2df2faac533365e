"""Labelled documents for the trained operators: who may be learned from, and a bounded sample of their features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import features as ft
from paperloom.llm import textbatch as tb

FOLDS, MIN_ROWS = 5, 3


def held_out(doc: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text divides by five, or there is no id."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def bounded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the keys; all of them if there are fewer."""
    n = rows.count()
    share = min(1.0, most / n) if n else 1.0
    return rows.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def sample_features(
    docs: DataFrame, labels: DataFrame, label: str, features, most: int, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(label, seed, features array<int>) of at most about ``most`` labelled documents outside the held-out fold.

    Repeated labels of a document count once, the larger one; labels are few and small, so the sample of them, whose
    size is ``most``, is broadcast to the texts.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(F.max(label).cast("int").alias("label"))
    chosen = F.broadcast(bounded(known.filter(~held_out(F.col("doc"))), most, "doc"))
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(chosen, "doc").select("label", F.xxhash64("doc", "text").alias("seed"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, feature in ft.pieces(batch.column("text"), features):
                ends = np.searchsorted(row, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), batch.column("seed").slice(i, j - i), lists], names=["label", "seed", "features"])

    return tb.small_batches(texts).mapInArrow(work, "label int, seed long, features array<int>")


def fit_in_one_task(sample: DataFrame, fit) -> dict[str, np.ndarray]:
    """Run ``fit(labels, row starts, features)`` over a bounded sample in one task; its named float arrays come back.

    Rows are ordered by their seed first, so the model does not depend on how the sample arrived.  Features of fewer than
    ``MIN_ROWS`` rows are left out; what is held are 8 bytes for each other feature of a row, and one copy while sorting.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=SCHEMA)
        table = table.sort_by([("seed", "ascending"), ("label", "ascending")]).combine_chunks()
        lists = table.column("features").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        feature, label = lists.flatten().to_numpy(), table.column("label").to_numpy()
        row = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        often = (np.bincount(feature, minlength=ft.DIMS) >= MIN_ROWS)[feature]
        row, feature = row[often], feature[often]
        del table, lists, often
        model = fit(label, np.searchsorted(row, np.arange(len(label) + 1, dtype=np.int32)), feature)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(model)), pa.array([np.asarray(v, dtype=np.float64).tobytes() for v in model.values()], pa.binary())], names=["name", "value"]
        )

    found = sample.repartition(1).mapInArrow(work, "name string, value binary").collect()
    return {r["name"]: np.frombuffer(r["value"], dtype=np.float64) for r in found}


SCHEMA = pa.schema([("label", pa.int32()), ("seed", pa.int64()), ("features", pa.list_(pa.int32()))])


def score_rows(docs: DataFrame, doc: str, text: str, features, score, columns: str) -> DataFrame:
    """(doc, held_out, columns…) of every document; ``score(row, feature, n)`` gives one array per column for n rows."""
    names = [c.split()[0] for c in columns.split(",")]
    base = tb.small_batches(docs.select(F.col(doc).alias("doc"), held_out(F.col(doc)).alias("held_out"), F.col(text).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, feature in ft.pieces(batch.column("text"), features):
                values = [pa.array(v) for v in score(row, feature, j - i)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(i, j - i), batch.column("held_out").slice(i, j - i), *values], names=["doc", "held_out", *names])

    kind = base.schema["doc"].dataType.simpleString()
    return base.mapInArrow(work, f"doc {kind}, held_out boolean, {columns}").withColumnRenamed("doc", doc)
