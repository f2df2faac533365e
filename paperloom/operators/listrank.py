"""Reranking by models that see a question with a whole list of passages, such as cross-encoders behind a service.

A list is cut into blocks of bounded length; every block is one call.  The model answers with (index, score) pairs in any
order; indexes outside the block, repeated ones and scores that are no numbers are ignored and counted.  The blocks of a
question are merged by score.  If a block fails after all tries, the whole question keeps its order with the fallback
scores and the reason; the others are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.hooks import attempt
from paperloom.session import cut_lineage

ListReranker = Callable[[str, list[str], int], list[tuple[int, float]]]
BLOCK = 100


def _called(blocks: DataFrame, model: ListReranker, top_n: int, tries: int, wait: float) -> DataFrame:
    """(query_id, rank, score, ignored, reason): a row per accepted index, or one without a rank per failed or empty block."""

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        question, texts = pdf["question"].iloc[0], pdf["content"].fillna("").tolist()
        (found,), (reason,) = attempt(lambda lists: [model(question, lists[0], top_n)], [texts], tries, wait)
        rows, seen, ignored = [], set(), 0
        for pair in found or []:
            try:
                index, score = int(pair[0]), float(pair[1])
                usable = index == pair[0] and 0 <= index < len(texts) and index not in seen and not math.isnan(score)
            except (TypeError, ValueError, IndexError, OverflowError):
                usable = False
            if usable:
                seen.add(index)
                rows.append((int(pdf["rank"].iloc[index]), score))
            else:
                ignored += 1
        rows = [(r, s, 0, None) for r, s in rows] + [(None, None, ignored, reason)]
        out = pd.DataFrame(rows, columns=["rank", "score", "ignored", "reason"]).astype({"rank": "Int64"})
        return out.assign(query_id=pdf["query_id"].iloc[0])

    kind = blocks.schema["query_id"].dataType.simpleString()
    schema = f"rank long, score double, ignored long, reason string, query_id {kind}"
    return blocks.groupBy("query_id", "block").applyInPandas(call, schema)


def rerank_lists(
    contexts: DataFrame, questions: DataFrame, model: ListReranker, top_n: int, block: int = BLOCK, tries: int = 3, wait: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(reranked contexts, one row of information per question).

    ``contexts`` has query_id, rank (from 1) and content; ``questions`` has query_id and question.  Reranked contexts carry
    rerank_score and new_rank: the best ``top_n`` by score, or, where the model failed, all in their order with scores from 1
    down by 0.1.  The information is (query_id, method, original_count, reranked_count, ignored, reason).
    """
    lists = contexts.select("query_id", "rank", "content", F.floor((F.col("rank") - 1) / block).alias("block"))
    asked = lists.join(questions.select("query_id", "question"), "query_id")
    answers = cut_lineage(_called(asked, model, top_n, tries, wait))  # the model is asked once, however often its answers are read
    failed = answers.filter("reason IS NOT NULL").groupBy("query_id").agg(F.min("reason").alias("reason"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    good = answers.filter("rank IS NOT NULL").join(failed.select("query_id"), "query_id", "left_anti")
    good = good.withColumn("new_rank", F.row_number().over(best)).filter(F.col("new_rank") <= top_n)
    done = contexts.drop("rerank_score").join(good.select("query_id", "rank", F.col("score").alias("rerank_score"), "new_rank"), ["query_id", "rank"])
    kept = contexts.drop("rerank_score").join(failed.select("query_id"), "query_id", "left_semi")
    kept = kept.withColumn("rerank_score", F.bround(1.0 - (F.col("rank") - 1) * 0.1, 6)).withColumn("new_rank", F.col("rank").cast("int"))
    counts = contexts.groupBy("query_id").agg(F.count("*").alias("original_count"))
    ignored = answers.groupBy("query_id").agg(F.sum("ignored").alias("ignored"))
    made = done.groupBy("query_id").agg(F.count("*").alias("reranked_count"))
    info = counts.join(made, "query_id", "left").join(ignored, "query_id", "left").join(failed, "query_id", "left").select(
        "query_id", F.when(F.col("reason").isNull(), "reranking").otherwise("similarity_fallback").alias("method"), "original_count",
        F.coalesce("reranked_count", F.lit(0)).alias("reranked_count"), F.coalesce("ignored", F.lit(0)).alias("ignored"), "reason",
    )
    return done.unionByName(kept), info

