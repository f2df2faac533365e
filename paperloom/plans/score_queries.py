"""Scores of answer runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions import scores as sc
from paperloom.operators import evalscores as ev
from paperloom.operators import vectors
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import contains_any, s, strip, with_inputs
from paperloom.sources.readers import table

M = v.METRICS
_JUDGE = "CASE item_id % 7 WHEN 0 THEN '0.' || item_id WHEN 1 THEN 'Score: ' || (item_id % 10) || '/10' WHEN 2 THEN ' I give 0.65 ' WHEN 3 THEN 'none' WHEN 4 THEN '' WHEN 5 THEN '-0.5' ELSE '1e-1' END"


def _judge(i):
    n = i.cast("string")
    return (
        F.when(i % 7 == 0, F.concat(F.lit("0."), n)).when(i % 7 == 1, F.concat(F.lit("Score: "), (i % 10).cast("string"), F.lit("/10")))
        .when(i % 7 == 2, " I give 0.65 ").when(i % 7 == 3, "none").when(i % 7 == 4, "").when(i % 7 == 5, "-0.5").otherwise("1e-1")
    )


def _parsed_sql(take: str) -> str:
    nums = f"regexp_extract_all(t, '([0-9]+\\.?[0-9]*)', 1)"
    part = f"try_cast({nums}[{-1 if take == 'last' else 1}] AS DOUBLE)"
    raw = f"coalesce(try_cast(nullif(trim(t), '') AS DOUBLE), {part})"
    return f"CASE WHEN {raw} IS NOT NULL THEN greatest(0, least(1, {raw})) END"


@query("l1_parse_score", f"SELECT item_id, {_parsed_sql('last')} AS last_number, {_parsed_sql('first')} AS first_number FROM (SELECT item_id, {_JUDGE} AS t FROM benchmark)")
def _(spark, sf):
    t = _judge(F.col("item_id"))
    return table(spark, sf, "benchmark").select("item_id", sc.parse_score(t).alias("last_number"), sc.parse_score(t, "first").alias("first_number"))


@query(
    "l2_answer_relevancy",
    """SELECT item_id, CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE round(coalesce(sem * 0.4::DOUBLE + judge * 0.6::DOUBLE, sem, judge), 4) END AS answer_relevancy,
    CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE round(sem, 4) END AS semantic_similarity, CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE judge END AS judge_relevancy FROM
    (SELECT item_id, greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)) AS sem, CASE WHEN item_id % 4 <> 0 THEN (item_id % 11)::DOUBLE / 10 END AS judge
    FROM benchmark JOIN embeddings a ON a.vec_id = item_id JOIN embeddings b ON b.vec_id = item_id + 1)""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = table(spark, sf, "benchmark")
    i = F.col("item_id")
    both = b.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("a")), "item_id").join(
        e.select((F.col("vec_id") - 1).alias("item_id"), F.col("embedding").alias("b")), "item_id"
    )
    judge = F.when(i % 4 != 0, F.least(F.lit(1.0), (i % 11).cast("double") / 10))
    r = sc.answer_relevancy(F.col("text"), F.when(i % 9 == 0, " ").otherwise(F.col("text")), vectors.cosine(F.col("a"), F.col("b")), judge)
    return both.select("item_id", *[c.alias(n) for n, c in r.items()])


@query(
    "l3_first_relevant",
    with_inputs("SELECT query_id, CAST(coalesce(min(rank) FILTER (WHERE (doc_id * 7 + query_id) % 9 = 0), count(*) + 1) AS INTEGER) AS context_precision FROM contexts GROUP BY query_id"),
)
def _(spark, sf):
    relevant = (F.col("doc_id") * 7 + F.col("query_id")) % 9 == 0
    return ev.first_relevant(inputs.contexts(spark, sf), relevant, within=50)


@query(
    "l3_judged_contexts",
    with_inputs(
        """SELECT query_id, md5(CASE WHEN length(t) > 3000 THEN left(t, 3000) || '...[truncated]' ELSE t END) AS judge_md5 FROM (SELECT query_id, string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank) AS t FROM
        (SELECT * FROM contexts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5) GROUP BY query_id)"""
    ),
)
def _(spark, sf):
    return ev.judged_contexts(inputs.contexts(spark, sf), max_contexts=5, max_chars=3000).select("query_id", F.md5("judge_text").alias("judge_md5"))


@query(
    "l4_judged_scores",
    with_inputs(
        """SELECT model, mode, question_id, CASE WHEN trim(answer) = '' THEN 0.0 WHEN n_contexts = 0 THEN NULL ELSE quality_score END AS faithfulness,
        CASE WHEN trim(answer) = '' THEN 0.0 WHEN trim(ground_truth) = '' THEN NULL ELSE quality_score END AS correctness FROM eval_runs"""
    ),
)
def _(spark, sf):
    r = inputs.eval_runs(spark, sf)
    a, g, q = F.col("answer"), F.col("ground_truth"), F.col("quality_score")
    return r.select("model", "mode", "question_id", sc.faithfulness(a, F.col("n_contexts"), q).alias("faithfulness"), sc.correctness(a, g, q).alias("correctness"))


_RETRY = ", ".join(f"coalesce(CASE WHEN n.question_id % 3 = 0 THEN n.quality_score END, o.{m}) AS {m}" for m in M)


@query(
    "l5_merge_retry",
    with_inputs(
        f"""SELECT model, mode, question_id, {_RETRY} FROM (SELECT * FROM eval_runs WHERE error IS NULL) o FULL JOIN (SELECT * FROM eval_runs WHERE {' + '.join(f'({m} IS NULL)::INTEGER' for m in M)} >= 3) n USING (model, mode, question_id)""".replace("n.question_id", "question_id")
    ),
)
def _(spark, sf):
    r = inputs.eval_runs(spark, sf)
    retried = r.filter(ev.needs_retry())
    new = retried.select(*ev.SHEET, *[F.when(F.col("question_id") % 3 == 0, F.col("quality_score")).alias(m) for m in M])
    return ev.merge_retry(r.filter(F.col("error").isNull()), new)


def means_sql(prefix: str = "") -> str:
    return ", ".join(f"avg({m}) FILTER (WHERE error IS NULL) AS {m}" for m in M)


def row_mean_sql(cols) -> str:
    return f"list_avg(list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL))"


MEANS = f"SELECT model, mode, {means_sql()} FROM eval_runs GROUP BY model, mode"


@query("l6_metric_means", with_inputs(f"SELECT model, mode, {', '.join(f'round({m}, 9) AS {m}' for m in M)}, round({row_mean_sql(M)}, 9) AS average_score FROM means", means=MEANS))
def _(spark, sf):
    m = ev.metric_means(inputs.eval_runs(spark, sf))
    return m.select("model", "mode", *[F.round(c, 9).alias(c) for c in M + ["average_score"]])


def _fact_value(j: int) -> str:
    return f"CASE WHEN (question_id + {j}) % 5 <> 0 THEN ((question_id * 7 + {j} * 3) % 11)::DOUBLE / 10 END"


@query(
    "l7_fact_aggregates",
    with_inputs(
        "SELECT model, mode, " + ", ".join(f"round(avg(coalesce({_fact_value(j)}, 0)), 4) AS {c}" for j, c in enumerate(v.FACT_MEANS)) + ", "
        + ", ".join(f"CAST(sum((question_id + {j}) % 3) AS BIGINT) AS total_{c}" for j, c in enumerate(v.FACT_SUMS)) + " FROM eval_runs GROUP BY model, mode"
    ),
)
def _(spark, sf):
    r, q = inputs.eval_runs(spark, sf), F.col("question_id")
    facts = r.select(
        "model", "mode",
        *[F.when((q + j) % 5 != 0, ((q * 7 + j * 3) % 11).cast("double") / 10).alias(c) for j, c in enumerate(v.FACT_MEANS)],
        *[((q + j) % 3).alias(c) for j, c in enumerate(v.FACT_SUMS)],
    )
    return ev.fact_aggregates(facts, ["model", "mode"])


@query(
    "l8_performance",
    with_inputs(
        """SELECT model, mode, round(avg(response_time), 9) AS avg_response_time, sum(response_time) AS total_time, count(error) AS error_count,
        round(avg(iterations) FILTER (WHERE contains(mode, 'agentic')), 9) AS avg_iterations, round(avg(quality_score) FILTER (WHERE contains(mode, 'agentic')), 9) AS avg_quality_score FROM eval_runs GROUP BY model, mode"""
    ),
)
def _(spark, sf):
    p = ev.performance(inputs.eval_runs(spark, sf))
    return p.select("model", "mode", *[F.round(c, 9).alias(c) for c in ("avg_response_time", "avg_iterations", "avg_quality_score")], "total_time", "error_count")


@query(
    "l8_event_performance",
    "SELECT event_type AS mode, round(avg(value), 6) AS avg_response_time, round(sum(value), 2) AS total_time, count(*) FILTER (WHERE event_type = 'error') AS error_count FROM events GROUP BY event_type",
)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("mode"), F.col("value").alias("response_time"), F.when(F.col("event_type") == "error", "error").alias("error"),
        F.lit(0).alias("iterations"), F.lit(0.0).alias("quality_score"),
    )
    return ev.performance(e, ["mode"]).select("mode", F.round("avg_response_time", 6).alias("avg_response_time"), F.round("total_time", 2).alias("total_time"), "error_count")


FAILED = f"({contains_any('answer', v.ANSWER_ERROR_MARKS)} OR (coalesce(error, '') <> '' AND ({contains_any('error', v.ERROR_FIELD_MARKS)} OR {strip('answer')} = '')))"


@query("l9_generation_failed", with_inputs(f"SELECT model, mode, question_id, {FAILED} AS failed FROM eval_runs"))
def _(spark, sf):
    return ev.split_for_resume(inputs.eval_runs(spark, sf)).select("model", "mode", "question_id", "failed")


@query(
    "l9_failed_turns",
    f"SELECT conv_id, turn, {FAILED} AS failed FROM (SELECT conv_id, turn, text AS answer, CASE WHEN turn % 4 = 0 THEN 'timeout' WHEN turn % 4 = 1 THEN 'odd' END AS error FROM conversations)",
)
def _(spark, sf):
    t = F.col("turn") % 4
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("answer"), F.when(t == 0, "timeout").when(t == 1, "odd").alias("error"))
    return ev.split_for_resume(c).select("conv_id", "turn", "failed")


_PENDING_KEY = "model || '/' || mode || '/' || question_id"


@query("l10_pending", with_inputs(f"SELECT {_PENDING_KEY} AS run_id, question FROM eval_runs WHERE {FAILED}"))
def _(spark, sf):
    r = inputs.eval_runs(spark, sf).withColumn("run_id", F.concat_ws("/", "model", "mode", F.col("question_id").cast("string")))
    return ev.pending(r.select("run_id", "question"), r, "run_id")


@query(
    "l11_mode_comparison",
    with_inputs(
        f"SELECT model, mode, round({row_mean_sql(['answer_relevancy', 'answer_correctness', 'answer_similarity'])}, 6) AS answer_mean, round({row_mean_sql(['faithfulness', 'context_precision', 'context_recall'])}, 6) AS retrieval_mean, round({row_mean_sql(M)}, 6) AS average_score FROM means", means=MEANS,
    ),
)
def _(spark, sf):
    return ev.mode_comparison(inputs.eval_runs(spark, sf))


@query(
    "l11_metric_by_mode",
    with_inputs("SELECT model, " + ", ".join(f"round(avg(faithfulness) FILTER (WHERE mode = {s(m)} AND coalesce(error, '') = ''), 9) AS {m}" for m in v.MODES) + " FROM eval_runs GROUP BY model"),
)
def _(spark, sf):
    return ev.metric_by_mode(inputs.eval_runs(spark, sf), "faithfulness")


_HAS = {"a": "trim(answer) <> ''", "g": "trim(ground_truth) <> ''", "q": "trim(question) <> ''", "c": "n_contexts > 0"}
_NEEDS = {"faithfulness": "c", "answer_correctness": "ag", "answer_relevancy": "aq", "context_recall": "gc", "context_precision": "c", "answer_similarity": "ag"}


@query(
    "l12_missing_metrics",
    with_inputs(" UNION ALL ".join(f"SELECT model, mode, question_id, {s(m)} AS metric FROM eval_runs WHERE {m} IS NULL AND {' AND '.join(_HAS[x] for x in _NEEDS[m])}" for m in M)),
)
def _(spark, sf):
    return ev.missing_metrics(inputs.eval_runs(spark, sf))


@query(
    "l13_apply_repair",
    with_inputs("SELECT model, mode, question_id, metric, CASE WHEN value IS NULL AND question_id % 2 = 0 THEN 0.5 ELSE value END AS value FROM eval_long"),
)
def _(spark, sf):
    long = ev.long_scores(inputs.eval_runs(spark, sf), keep=["model", "mode", "question_id"])
    fixed = long.filter(F.col("value").isNull()).withColumn("value", F.when(F.col("question_id") % 2 == 0, 0.5))
    return ev.apply_repair(long, fixed)


@query(
    "l13_repaired_means",
    with_inputs("SELECT model, mode, metric, round(avg(CASE WHEN value IS NULL AND question_id % 2 = 0 THEN 0.5 ELSE value END), 9) AS mean FROM eval_long GROUP BY ALL"),
)
def _(spark, sf):
    long = ev.long_scores(inputs.eval_runs(spark, sf), keep=["model", "mode", "question_id"])
    fixed = long.filter(F.col("value").isNull()).withColumn("value", F.when(F.col("question_id") % 2 == 0, 0.5))
    return ev.apply_repair(long, fixed).groupBy("model", "mode", "metric").agg(F.round(F.avg("value"), 9).alias("mean"))


@query(
    "l14_batch_report",
    with_inputs(
        """SELECT model, mode, count(*) AS questions, count(*) FILTER (WHERE trim(answer) <> '') AS valid_answers, count(*) FILTER (WHERE n_contexts > 0) AS valid_contexts,
        count(*) FILTER (WHERE trim(ground_truth) <> '') AS valid_ground_truths, round(avg(n_contexts), 6) AS mean_contexts, round(avg(response_time), 6) AS mean_time,
        CASE WHEN avg(quality_score) >= 0.8 THEN 'excellent' WHEN avg(quality_score) >= 0.6 THEN 'good' ELSE 'needs improvement' END AS level FROM eval_runs GROUP BY model, mode"""
    ),
)
def _(spark, sf):
    return ev.batch_report(inputs.eval_runs(spark, sf))


@query(
    "l14_enhanced_share",
    with_inputs("SELECT model, mode, count(*) FILTER (WHERE mode = 'agentic_with_kg' AND n_contexts > 0) AS enhanced, round_even(count(*) FILTER (WHERE mode = 'agentic_with_kg' AND n_contexts > 0) * 100 / count(*), 6) AS enhanced_share FROM eval_runs GROUP BY model, mode"),
)
def _(spark, sf):
    return ev.enhanced_share(inputs.eval_runs(spark, sf), (F.col("mode") == v.MODES[2]) & (F.col("n_contexts") > 0))


_MEANS = " UNION ALL ".join(f"SELECT model, mode, '{m}' AS metric, avg({m}) AS x FROM eval_runs GROUP BY model, mode" for m in v.METRICS)


@query(
    "l14_metric_bands",
    with_inputs(
        """SELECT model, mode, metric, mean, CASE WHEN mean >= 0.8 THEN 'excellent' WHEN mean >= 0.6 THEN 'good' ELSE 'needs improvement' END AS level FROM
        (SELECT model, mode, metric, round(x, 9) AS mean FROM means WHERE x IS NOT NULL UNION ALL SELECT model, mode, 'overall', round(avg(x), 9) FROM means GROUP BY model, mode HAVING count(x) > 0)""",
        means=_MEANS,
    ),
)
def _(spark, sf):
    return ev.metric_bands(inputs.eval_runs(spark, sf))


@query(
    "l15_success_rate",
    "SELECT role, count(*) AS queries, count(*) FILTER (WHERE length(text) > 100) AS succeeded, round(avg((length(text) > 100)::INTEGER) * 100, 6) AS success_rate FROM conversations GROUP BY role",
)
def _(spark, sf):
    return ev.success_rate(table(spark, sf, "conversations"), F.length("text") > 100, ["role"])
