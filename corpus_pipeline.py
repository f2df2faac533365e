"""The corpus pipeline: documents through five stages, each from what its predecessor kept.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next one.  All but the last return the columns of ``documents``.  The first and the
fourth stage cannot be said in SQL (a trained model, reported spans cut out of texts), so ``ORACLE_SQL`` is None and the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, chosenpath, decontam, secrets, toxicity
from paperloom.session import new_path, prepare
from paperloom.sources.readers import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labelled ones outside the held-out fold."""
    prepare(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by a similarity of 0.8 or more, directly or in a chain, the one of least id stays."""
    prepare(spark)
    return chosenpath.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    prepare(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in their texts; every document stays."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars")))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids as little-endian 32-bit integers and the text they decode to."""
    prepare(spark)
    encoded = bpe.encode(docs, RANKS, decoded=True)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", without_secrets),
    ("bpe", as_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through every stage; each stage's result is written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
