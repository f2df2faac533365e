"""Queries of the operators that work on whole corpora in Arrow batches; their tests hold them against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, chosenpath, fingerprints, langid, quality, toxicity
from paperloom.llm.registry import llm_query
from paperloom.sources.readers import table


@llm_query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    classes = chosenpath.similarity_classes(table(spark, sf, "documents").select("doc_id", "text"))
    return classes.select("doc_id", F.col("keep_doc").alias("class_id"), "n_links")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@llm_query("op9_bpe_round_trip")
def op9_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), RANKS, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@llm_query("op6_document_fingerprints")
def op6_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's fingerprint next to those of its edited text and of the next document."""
    return fingerprints.edit_report(table(spark, sf, "documents").select("doc_id", "text"))


@llm_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Expected severity of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf, "labels").select("doc_id", "toxic")))


@llm_query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels").select("doc_id", "quality")))


@llm_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))
