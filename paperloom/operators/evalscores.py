"""Scores of answer runs: retries, means, resume and repair plans, reports.

Runs come as one wide row per (model, mode, question) with a column per metric; ``long_scores`` turns them into one row
per metric.  Errors and NULL or NaN scores never enter a mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.scores import generation_failed, is_blank, no_nan
from paperloom.functions.text import strip

RUN = ["model", "mode"]
SHEET = ["model", "mode", "question_id"]
ANSWER_METRICS = ["answer_relevancy", "answer_correctness", "answer_similarity"]
RETRIEVAL_METRICS = ["faithfulness", "context_precision", "context_recall"]


def has_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def long_scores(runs: DataFrame, metrics: list[str] = v.METRICS, keep: list[str] | None = None) -> DataFrame:
    """One row per run, question and metric."""
    ids = keep or [c for c in runs.columns if c not in v.METRICS]
    return runs.unpivot(ids, metrics, "metric", "value")


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns that are not NULL, NULL if none is."""
    kept = F.filter(F.array(*[F.col(c) for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def first_relevant(contexts: DataFrame, relevant: Column, within: int | None = None) -> DataFrame:
    """Position of the first relevant context, n + 1 without one, NULL where all contexts are blank.

    ``within`` is how many valid contexts a judge looks at; by default all.
    """
    valid = strip(F.col("content")) != ""
    nth = F.sum(valid.cast("int")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    seen = contexts.withColumns({"_valid": valid, "_nth": nth, "_rel": relevant})
    hit = F.min(F.when(F.col("_valid") & F.col("_rel") & (F.lit(True) if within is None else F.col("_nth") <= within), F.col("rank")))
    none = F.when(F.count_if("_valid") > 0, F.count("*") + 1)
    return seen.groupBy("query_id").agg(F.coalesce(hit, none).cast("int").alias("context_precision"))


def judged_contexts(contexts: DataFrame, max_contexts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The text a judge sees: the valid contexts joined; a judge with an input limit names how many and how long."""
    valid = contexts.filter(strip(F.col("content")) != "")
    w = Window.partitionBy("query_id").orderBy("rank")
    first = valid.withColumn("_r", F.row_number().over(w))
    first = first if max_contexts is None else first.filter(F.col("_r") <= max_contexts)
    joined = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "content"))).alias("_c"))
    text = F.array_join(F.transform("_c", lambda x: x["content"]), "\n---\n")
    if max_chars is None:
        return joined.select("query_id", text.alias("judge_text"))
    return joined.select("query_id", text.alias("_t")).select(
        "query_id", F.when(F.length("_t") > max_chars, F.concat(F.left("_t", F.lit(max_chars)), F.lit("...[truncated]"))).otherwise(F.col("_t")).alias("judge_text")
    )


def merge_retry(old: DataFrame, new: DataFrame, keys: list[str] = SHEET, metrics: list[str] = v.METRICS) -> DataFrame:
    """Two score sheets of the same answers: the retry's score where there is one, else the first one."""
    o = old.select(*keys, *[F.col(m).alias(f"o_{m}") for m in metrics])
    return o.join(new.select(*keys, *metrics), keys, "full_outer").select(
        *keys, *[F.coalesce(m, f"o_{m}").alias(m) for m in metrics]
    )


def needs_retry(metrics: list[str] = v.METRICS) -> Column:
    """Half or more of the metrics failed."""
    failed = sum((no_nan(F.col(m)).isNull().cast("int") for m in metrics), F.lit(0))
    return failed >= len(metrics) // 2


def metric_means(runs: DataFrame, by: list[str] = RUN, metrics: list[str] = v.METRICS) -> DataFrame:
    """Mean of every metric over rows without errors, and the mean of the six means."""
    ok = ~has_error() if "error" in runs.columns else F.lit(True)
    means = runs.groupBy(*by).agg(*[F.avg(F.when(ok, no_nan(F.col(m)))).alias(m) for m in metrics])
    return means.withColumn("average_score", row_mean(metrics))


def fact_aggregates(facts: DataFrame, by: list[str]) -> DataFrame:
    """Seven means and three sums over fact sheets; missing counts as 0."""
    zero = F.lit(0)
    return facts.groupBy(*by).agg(
        *[F.bround(F.avg(F.coalesce(c, zero)), 4).alias(c) for c in v.FACT_MEANS],
        *[F.sum(F.coalesce(c, zero)).alias(f"total_{c}") for c in v.FACT_SUMS],
    )


def performance(runs: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Mean and total time and errors; rounds and quality for agentic modes only."""
    agentic = F.col("mode").contains("agentic")
    zero = F.lit(0)
    return runs.groupBy(*by).agg(
        F.avg(F.coalesce("response_time", zero)).alias("avg_response_time"), F.sum(F.coalesce("response_time", zero)).alias("total_time"),
        F.count_if(has_error()).alias("error_count"), F.avg(F.when(agentic, F.coalesce("iterations", zero))).alias("avg_iterations"),
        F.avg(F.when(agentic, F.coalesce("quality_score", zero))).alias("avg_quality_score"),
    )


def split_for_resume(runs: DataFrame) -> DataFrame:
    return runs.withColumn("failed", generation_failed(F.col("answer"), F.col("error")))


def pending(questions: DataFrame, runs: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions without a good answer yet."""
    done = split_for_resume(runs).filter(~F.col("failed")).select(key).distinct()
    return questions.join(done, key, "left_anti")


def mode_comparison(runs: DataFrame) -> DataFrame:
    """Per model and mode the mean of the answer metrics and of the retrieval metrics."""
    m = metric_means(runs)
    return m.select(
        *RUN, F.bround(row_mean(ANSWER_METRICS), 6).alias("answer_mean"), F.bround(row_mean(RETRIEVAL_METRICS), 6).alias("retrieval_mean"),
        F.bround("average_score", 6).alias("average_score"),
    )


def metric_by_mode(runs: DataFrame, metric: str) -> DataFrame:
    """One metric with a column per mode, over rows without errors."""
    ok = ~has_error() if "error" in runs.columns else F.lit(True)
    return runs.groupBy("model").pivot("mode", v.MODES).agg(F.bround(F.avg(F.when(ok, no_nan(F.col(metric)))), 9))


def missing_metrics(runs: DataFrame, metrics: list[str] = v.METRICS) -> DataFrame:
    """(run, question, metric) to compute again: the score is missing and its inputs are there."""
    answer, truth, question = (~is_blank(F.col(c)) for c in ("answer", "ground_truth", "question"))
    ctx = F.col("n_contexts") > 0
    needs = {
        "faithfulness": ctx, "answer_correctness": answer & truth, "answer_relevancy": answer & question, "context_recall": truth & ctx,
        "context_precision": ctx, "answer_similarity": answer & truth,
    }
    todo = F.filter(F.array(*[F.when(no_nan(F.col(m)).isNull() & needs[m], m) for m in metrics]), lambda x: x.isNotNull())
    return runs.select(*SHEET, F.explode(todo).alias("metric"))


def apply_repair(scores: DataFrame, repaired: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """Fill missing scores of a long table with repaired ones; scores that exist stay."""
    new = repaired.select(*keys, "metric", F.col("value").alias("_new"))
    return scores.join(new, [*keys, "metric"], "left").withColumn("value", F.coalesce("value", "_new")).drop("_new")


def batch_report(runs: DataFrame, by: list[str] = RUN) -> DataFrame:
    """Counts of usable answers, contexts and ground truths, mean contexts and time, and a level of the mean score."""
    share = F.avg("quality_score")
    return runs.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count_if(~is_blank(F.col("answer"))).alias("valid_answers"), F.count_if(F.col("n_contexts") > 0).alias("valid_contexts"),
        F.count_if(~is_blank(F.col("ground_truth"))).alias("valid_ground_truths"), F.bround(F.avg("n_contexts"), 6).alias("mean_contexts"),
        F.bround(F.avg("response_time"), 6).alias("mean_time"),
        F.when(share >= 0.8, "excellent").when(share >= 0.6, "good").otherwise("needs improvement").alias("level"),
    )


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").otherwise("needs improvement")


def enhanced_share(runs: DataFrame, enhanced: Column, by: list[str] = RUN) -> DataFrame:
    """How many answers used the graph, and their share in percent."""
    return runs.groupBy(*by).agg(F.count_if(enhanced).alias("enhanced"), F.bround(F.count_if(enhanced) * 100 / F.count("*"), 6).alias("enhanced_share"))


def metric_bands(runs: DataFrame, metrics: list[str] = v.METRICS, by: list[str] = RUN) -> DataFrame:
    """(by, metric, mean, level) of every metric that has a value, and of their mean as metric ``overall``."""
    each = [F.struct(F.lit(m).alias("metric"), F.avg(no_nan(F.col(m))).alias("mean")) for m in metrics]
    long = runs.groupBy(*by).agg(F.array(*each).alias("m")).select(*by, F.filter("m", lambda x: x["mean"].isNotNull()).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x["mean"]) / F.size("m")
    overall = F.when(F.size("m") > 0, F.array(F.struct(F.lit("overall").alias("metric"), total.alias("mean")))).otherwise(F.slice("m", 1, 0))
    rows = long.select(*by, F.explode(F.concat("m", overall)).alias("r")).select(*by, "r.metric", F.round("r.mean", 9).alias("mean"))
    return rows.withColumn("level", level(F.col("mean")))


def success_rate(runs: DataFrame, success: Column, by: list[str] | None = None) -> DataFrame:
    return runs.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.count_if(success).alias("succeeded"), F.bround(F.avg(success.cast("double")) * 100, 6).alias("success_rate"))
