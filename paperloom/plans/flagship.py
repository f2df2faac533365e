"""The end-to-end query: documents to tagged passages, questions to evidence, evidence to a budgeted context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import questions as qs
from paperloom.functions.text import clean_document_text
from paperloom.operators import fusion, vectors
from paperloom.operators.chunking import tagged_passages
from paperloom.plans import inputs
from paperloom.session import cut_lineage


def embedded_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, sectioned, tagged passages with model-free vectors and a numeric key."""
    docs = inputs.papers(spark, sf).withColumn("text", clean_document_text(F.col("text")))
    p = tagged_passages(docs)
    keyed = p.withColumn("vec_id", F.col("doc_id") * 1_000_000 + F.col("global_chunk_id"))
    return vectors.hashed_embedding(keyed, "content")


def answer_contexts(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    questions = inputs.questions(spark, sf).withColumnRenamed("item_id", "query_id")
    asked = vectors.hashed_embedding(questions.withColumn("query", qs.enhanced_query(F.col("question"))), "query")
    # the passage index is a table: the search reads ids and vectors, the lookup reads the passages found
    corpus = cut_lineage(embedded_passages(spark, sf))
    near = vectors.top_k(asked.select("query_id", "embedding"), corpus.select("vec_id", "embedding"), k)
    found = near.join(corpus.drop("embedding").withColumnRenamed("source", "origin"), "vec_id").select(
        "query_id", "rank", F.col("vec_id").alias("doc_id"), "similarity", F.lit(None).cast("double").alias("rerank_score"),
        F.concat_ws(".", F.lit("vector"), "origin").alias("source"), "section_type", "has_numerical_data", "content",
    )
    kept = fusion.relevant(found.join(questions, "query_id"), F.col("question"), threshold=0.1, relaxed=0.05).drop("question")
    unique = fusion.drop_near_copies(kept, ["query_id"], ["rank"])
    merged = fusion.merge_sources(unique)
    text = fusion.budgeted_text(merged, "final_rank")
    return questions.join(text, "query_id").join(fusion.citations(merged), "query_id")
