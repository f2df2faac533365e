"""Quality of the evidence found, what is missing, and retrieval in rounds over all unfinished questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.questions import answer_expectations
from paperloom.functions.scores import clamp, stable_round
from paperloom.functions.tagging import find_all
from paperloom.functions.text import any_of, ci, content_hash, has_any, strip
from paperloom.operators.vectors import cosine, embed_once
from paperloom.session import cut_lineage

Q = "query_id"


# --- scores --------------------------------------------------------------------------------------------------------
def relevance(contexts: DataFrame, first: int = 10, default: float = 0.5) -> DataFrame:
    """Mean similarity (else rerank score) of the first contexts; the default where none has a score.

    Contexts without a score count only after ``scored_by_cosine``.
    """
    value = F.coalesce("similarity", "rerank_score")
    ranked = contexts.withColumn("_r", F.row_number().over(Window.partitionBy(Q).orderBy("rank")))
    mean = F.avg(F.when(F.col("_r") <= first, value))
    return ranked.groupBy(Q).agg(F.coalesce(mean, F.lit(default)).alias("relevance"))


def scored_by_cosine(contexts: DataFrame, questions: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], first: int = 10, question: str = "question") -> DataFrame:
    """``contexts`` with a computed similarity where one of the first contexts has no score at all.

    Vectors are made on demand: once per distinct text, for unscored contexts with content and for the questions that have
    some.  Where a vector cannot be made the score stays NULL.
    """
    ranked = contexts.withColumn("_r", F.row_number().over(Window.partitionBy(Q).orderBy("rank")))
    bare = F.coalesce("similarity", "rerank_score").isNull() & (F.col("_r") <= first) & (F.coalesce("content", F.lit("")) != "")
    open_ = ranked.filter(bare).select(Q, "rank", "content").join(questions.select(Q, F.col(question).alias("_q")), Q)
    texts = open_.select(F.col("content").alias("text")).unionByName(open_.select(F.col("_q").alias("text")))
    made = embed_once(texts.distinct(), embed_fn).filter("embedding IS NOT NULL").select("content_hash", "embedding")
    made = cut_lineage(made)  # the model is asked once
    both = (
        open_.select(Q, "rank", content_hash(F.col("content")).alias("_c"), content_hash(F.col("_q")).alias("_h"))
        .join(made.toDF("_c", "_a"), "_c").join(made.toDF("_h", "_b"), "_h")
    )
    scored = both.select(Q, "rank", cosine(F.col("_a"), F.col("_b")).alias("_s"))
    return contexts.join(scored, [Q, "rank"], "left").withColumn("similarity", F.coalesce("similarity", F.when(F.col("rerank_score").isNull(), F.col("_s")))).drop("_s")


def confidence(contexts: DataFrame) -> DataFrame:
    """Mean of source diversity (five sources are full), mean score where there is one, and diversity again."""
    diversity = F.least(F.count_distinct("source") / 5, F.lit(1.0))
    mean = F.avg(F.coalesce("rerank_score", "similarity"))
    return contexts.groupBy(Q).agg(
        F.when(mean.isNull(), diversity).otherwise((diversity * 2 + mean) / 3).alias("confidence"), F.count("*").alias("n_contexts")
    )


def coverage(answer: Column) -> Column:
    """A judge's answer as a share: the number clamped to 0..1, or 0.5 when it is no number."""
    return F.coalesce(clamp(strip(answer).try_cast("double")), F.lit(0.5))


def overall(rel: Column, cov: Column, conf: Column) -> Column:
    return rel * 0.4 + cov * 0.4 + conf * 0.2


def evaluate(contexts: DataFrame, judged: DataFrame) -> DataFrame:
    """Relevance, coverage, confidence and overall score per question; ``judged`` holds (query_id, judge_answer)."""
    both = relevance(contexts).join(confidence(contexts), Q).join(judged, Q, "left")
    cov = coverage(F.col("judge_answer"))
    return both.select(
        Q, "n_contexts", stable_round(F.col("relevance"), 3).alias("relevance"), stable_round(cov, 3).alias("coverage"),
        stable_round(F.col("confidence"), 3).alias("confidence"), stable_round(overall(F.col("relevance"), cov, F.col("confidence")), 3).alias("overall"),
    )


# --- gaps and decisions ------------------------------------------------------------------------------------------------
def first_texts(contexts: DataFrame, n: int = 5) -> DataFrame:
    """The first n contexts of a question as one text."""
    w = Window.partitionBy(Q).orderBy("rank")
    top = contexts.select(Q, "rank", "content", F.row_number().over(w).alias("_r")).filter(F.col("_r") <= n)
    return top.groupBy(Q).agg(F.array_sort(F.collect_list(F.struct("_r", "content"))).alias("_c")).select(
        Q, F.array_join(F.transform("_c", lambda x: x["content"]), " ").alias("context_text")
    )


def gaps(question: Column, text: Column, n_contexts: Column, score: Column, threshold: float = v.QUALITY_THRESHOLD) -> Column:
    """What the evidence lacks, as an array of labels."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    numbers = F.filter(
        F.regexp_extract_all(text, F.lit(r"[0-9]+\.?[0-9]*"), F.lit(0)), lambda x: x.contains(".") | (x.try_cast("double") > 1)
    )
    names = F.filter(
        F.regexp_extract_all(question, F.lit(rf"{v.WORD_START}([A-Z][a-zA-Z0-9-]*)(?=$|[^a-zA-Z0-9-])"), F.lit(1)), lambda x: F.length(x) > 1
    )
    lost = F.exists(names, lambda x: ~low.contains(F.lower(x)))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    found = F.filter(
        F.array(
            F.when(n_contexts < 3, "insufficient_contexts"),
            F.when(score < threshold, "low_quality"),
            F.when(has_any(question, v.GAP_NUMBER_WORDS) & (F.size(numbers) < 2), "missing_numerical_values"),
            F.when(has_any(question, v.GAP_COMPARISON_WORDS) & (F.size(names) >= 2) & lost, "missing_comparison_data"),
            F.when(has_any(question, v.GAP_ENTITY_WORDS) & (words < 50), "missing_entities"),
            F.when(has_any(question, v.GAP_RELATION_WORDS) & ~has_any(text, v.CAUSAL_WORDS), "missing_relationships"),
        ),
        lambda x: x.isNotNull(),
    )
    return found


def recommended_action(score: Column, found: Column, threshold: float = v.QUALITY_THRESHOLD) -> Column:
    has = lambda g: F.array_contains(found, g)
    return (
        F.when(score >= threshold, "generate")
        .when(has("insufficient_contexts") | has("low_quality"), "reformulate_query")
        .when(has("missing_entities") | has("missing_relationships"), "enhance_kg_query")
        .when(has("missing_numerical_values") | has("missing_comparison_data"), "expand_retrieval")
        .otherwise("reformulate_query")
    )


def stop_reason(score: Column, round_no: Column | int, max_rounds: int = v.MAX_ROUNDS, threshold: float = v.QUALITY_THRESHOLD, early: float = v.EARLY_STOP) -> Column:
    """Why a question stops, or NULL to go on."""
    return (
        F.when(score >= early, "early_stop").when(score >= threshold, "quality_sufficient").when(F.lit(round_no) >= max_rounds, "max_iterations")
    )


def next_top_k(k: Column, action: Column, step: int = 10, top: int = 30) -> Column:
    return F.when(action == "expand_retrieval", F.least(k + step, F.lit(top))).otherwise(k)


# --- rounds --------------------------------------------------------------------------------------------------------------
Retrieve = Callable[[DataFrame, int], DataFrame]
Judge = Callable[[DataFrame, DataFrame, int], DataFrame]
Rewrite = Callable[[DataFrame], DataFrame]


def append_gaps(unfinished: DataFrame) -> DataFrame:
    """The model-free rewrite: the question with its gap labels appended as words."""
    return unfinished.withColumn("query", F.concat_ws(" ", "question", F.replace(F.array_join("gaps", " "), F.lit("_"), F.lit(" "))))


def retrieve_in_rounds(
    questions: DataFrame, retrieve: Retrieve, judge: Judge, rewrite: Rewrite = append_gaps, max_rounds: int = v.MAX_ROUNDS,
    threshold: float = v.QUALITY_THRESHOLD, top_k: int = v.VECTOR_TOP_K,
) -> tuple[DataFrame, DataFrame]:
    """(contexts, history) of a question table (query_id, question).

    Every round is one job over all unfinished questions.  ``retrieve(unfinished, round)`` returns contexts
    (query_id, doc_id, content, source, similarity, rerank_score), ``judge(unfinished, contexts, round)`` returns
    (query_id, judge_answer).  Contexts accumulate, each document once per question.  Rounds end in written tables, so
    the plan does not grow and a lost executor costs one round at most.
    """
    unfinished = questions.select(Q, "question", F.col("question").alias("query"), F.lit(top_k).alias("top_k"))
    contexts, history = None, None
    for round_no in range(1, max_rounds + 1):
        found = retrieve(unfinished, round_no).select(Q, "doc_id", "content", "source", "similarity", "rerank_score", F.lit(round_no).alias("round"))
        if contexts is not None:
            found = contexts.unionByName(found.join(contexts.select(Q, "doc_id"), [Q, "doc_id"], "left_anti"))
        contexts = cut_lineage(found)
        best_first = Window.partitionBy(Q).orderBy("round", F.desc(F.coalesce("similarity", F.lit(0.0))), "doc_id")
        current = contexts.join(unfinished.select(Q), Q, "left_semi").withColumn("rank", F.row_number().over(best_first))
        scored = (
            unfinished.join(evaluate(current, judge(unfinished, current, round_no)), Q, "left")
            .join(first_texts(current), Q, "left")
            .fillna({"n_contexts": 0, "overall": 0.0})
        )
        g = gaps(F.col("question"), F.col("context_text"), F.col("n_contexts"), F.col("overall"), threshold)
        step = scored.withColumn("gaps", g).withColumn("action", recommended_action(F.col("overall"), F.col("gaps"), threshold))
        step = step.withColumn("stop", stop_reason(F.col("overall"), round_no, max_rounds, threshold)).drop("context_text")
        step = cut_lineage(step.withColumn("round", F.lit(round_no)))
        row = step.select(Q, "round", "n_contexts", "relevance", "coverage", "confidence", "overall", "gaps", "action", "stop")
        history = row if history is None else history.unionByName(row)
        open_rows = step.filter(F.col("stop").isNull()).withColumn("top_k", next_top_k(F.col("top_k"), F.col("action")))
        if open_rows.isEmpty():
            break
        unfinished = cut_lineage(rewrite(open_rows).select(Q, "question", "query", "top_k"))
    return contexts, history


def run_summary(history: DataFrame) -> DataFrame:
    """How many rounds questions took: counts, shares in percent and mean final score per number of rounds."""
    last = history.groupBy(Q).agg(F.max("round").alias("rounds"), F.max_by("overall", "round").alias("quality"))
    total = F.sum("questions").over(Window.partitionBy())
    return (
        last.groupBy("rounds").agg(F.count("*").alias("questions"), F.bround(F.avg("quality"), 6).alias("mean_quality"))
        .withColumn("share", F.bround(F.col("questions") * 100 / total, 6))
    )


def run_totals(runs: DataFrame, rounds: str = "rounds", quality: str = "quality", seconds: str = "seconds", failed: Column | None = None) -> DataFrame:
    """One row over all questions: how many, the share that succeeded in percent, and the means of rounds, quality and time of those."""
    ok = F.lit(True) if failed is None else ~failed

    def mean(c: str) -> Column:
        return F.bround(F.avg(F.when(ok, F.col(c))), 6).alias(f"mean_{c}")

    return runs.agg(
        F.count("*").alias("questions"), F.count_if(ok).alias("succeeded"), F.bround(F.count_if(ok) * 100 / F.count("*"), 6).alias("success_rate"), mean(rounds), mean(quality), mean(seconds),
    )


# --- answer checks ---------------------------------------------------------------------------------------------------------
def evidence_elements(
    contexts: DataFrame, questions: DataFrame, question: str = "question", most_values: int | None = None, most_methods: int | None = None
) -> DataFrame:
    """Values and method names that the contexts offer, where the question expects such; all of them unless a most is given."""
    expect = answer_expectations(F.col(question))
    text = F.col("content")
    rows = contexts.join(questions, Q).select(
        Q,
        F.when(expect["expects_numbers"], F.array_distinct(find_all(text, v.EVIDENCE_UNITS))).alias("values"),
        F.when(expect["expects_method"], F.array_distinct(find_all(text, v.EVIDENCE_METHODS, 1))).alias("methods"),
    )
    empty = F.array().cast("array<string>")

    def distinct_sorted(c: str, limit: int | None) -> DataFrame:
        items = rows.select(Q, F.explode(c).alias("x")).distinct()
        if limit is not None:
            w = Window.partitionBy(Q).orderBy("x")
            items = items.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
        return items.groupBy(Q).agg(F.array_sort(F.collect_list("x")).alias(c))

    base = questions.select(Q)
    return (
        base.join(distinct_sorted("values", most_values), Q, "left").join(distinct_sorted("methods", most_methods), Q, "left")
        .select(Q, F.coalesce("values", empty).alias("values"), F.coalesce("methods", empty).alias("methods"))
    )


def check_answers(answers: DataFrame, elements: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Issues of an answer given the evidence: no numbers, too few numbers, no method name; confidence falls 0.3 each."""
    expect = answer_expectations(F.col(question))
    text = F.col(answer)
    found = F.size(find_all(text, v.ANSWER_UNITS))
    wants_numbers = expect["expects_numbers"] & (F.size("values") > 0)
    names_method = F.exists("methods", lambda m: F.lower(text).contains(F.lower(m)))
    issues = F.filter(
        F.array(
            F.when(wants_numbers & (found == 0), "Missing numerical values").when(
                wants_numbers & (expect["number_count"] > 0) & (found < expect["number_count"]), "Too few numbers"
            ),
            F.when(expect["expects_method"] & (F.size("methods") > 0) & ~names_method, "Missing specific method name"),
        ),
        lambda x: x.isNotNull(),
    )
    return answers.join(elements, Q).select(*answers.columns, issues.alias("issues")).select(
        "*", (F.size("issues") == 0).alias("valid"), F.bround(F.greatest(F.lit(0.0), 1.0 - F.size("issues") * 0.3), 6).alias("confidence")
    )
