"""Quality scores, gaps, decisions, rounds and answer checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.operators import loop, vectors
from paperloom.plans import inputs
from paperloom.plans.question_queries import EXPECT_SQL
from paperloom.plans.registry import query
from paperloom.plans.vector_queries import length_vectors
from paperloom.plans.sqlkit import concat_lists, contains_any, find_all, joined, s, with_inputs
from paperloom.session import cut_lineage
from paperloom.sources.readers import table

_ANSWERS = ["0.8", "1.4", "bad", " 0.35 ", ""]


def _judged(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), inputs.choose(F.col("item_id") % 5, _ANSWERS).alias("judge_answer"))


def _questions(spark, sf):
    return inputs.questions(spark, sf).withColumnRenamed("item_id", "query_id")


@query("j1_relevance", with_inputs("SELECT query_id, round(coalesce(avg(coalesce(similarity, rerank_score)) FILTER (WHERE r <= 10), 0.5), 9) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM contexts) GROUP BY query_id"))
def _(spark, sf):
    return loop.relevance(inputs.contexts(spark, sf)).select("query_id", F.round("relevance", 9).alias("relevance"))


_BARE = """SELECT query_id, rank, CASE WHEN doc_id % 3 <> 0 THEN similarity END AS similarity, CASE WHEN doc_id % 3 <> 0 THEN rerank_score END AS rerank_score,
    content, question, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM contexts JOIN questions ON item_id = query_id"""
_SIGNS = ", ".join(f"(length({{0}}) - length(replace({{0}}, {x}, '')))::DOUBLE" for x in ("'e'", "'a'", "chr(10)"))


@query(
    "j1_computed_relevance",
    with_inputs(
        f"""SELECT query_id, round(coalesce(avg(CASE WHEN r <= 10 THEN coalesce(similarity, rerank_score, CASE WHEN content <> '' THEN list_cosine_similarity([length(content)::DOUBLE, {_SIGNS.format('content')}],
        [length(question)::DOUBLE, {_SIGNS.format('question')}]) END) END), 0.5), 9) AS relevance FROM bare GROUP BY query_id""", bare=_BARE,
    ),
)
def _(spark, sf):
    """A third of the contexts have no score; theirs is the cosine of the question and the content."""
    c = inputs.contexts(spark, sf)
    bare = c.withColumns({x: F.when(F.col("doc_id") % 3 != 0, F.col(x)) for x in ("similarity", "rerank_score")})
    questions = inputs.questions(spark, sf).withColumnRenamed("item_id", "query_id")
    scored = loop.scored_by_cosine(bare, questions, length_vectors)
    return loop.relevance(scored).select("query_id", F.round("relevance", 9).alias("relevance"))


_CONF = "(least(count(DISTINCT source) / 5, 1.0) * 2 + avg(coalesce(rerank_score, similarity))) / 3"


@query("j2_confidence", with_inputs(f"SELECT query_id, round({_CONF}, 9) AS confidence, count(*) AS n_contexts FROM contexts GROUP BY query_id"))
def _(spark, sf):
    c = loop.confidence(inputs.contexts(spark, sf))
    return c.select("query_id", F.round("confidence", 9).alias("confidence"), "n_contexts")


@query("j3_coverage", "SELECT item_id AS query_id, [0.8, 1.0, 0.5, 0.35, 0.5][1 + item_id % 5]::DOUBLE AS coverage FROM benchmark")
def _(spark, sf):
    return _judged(spark, sf).select("query_id", loop.coverage(F.col("judge_answer")).alias("coverage"))


_EVAL = f"""SELECT query_id, n_contexts, round_even(round(rel, 9), 3) AS relevance, round_even(round(cov, 9), 3) AS coverage, round_even(round(conf, 9), 3) AS confidence, round_even(round(rel * 0.4::DOUBLE + cov * 0.4::DOUBLE + conf * 0.2::DOUBLE, 9), 3) AS overall FROM
    (SELECT query_id, count(*) AS n_contexts, avg(similarity) FILTER (WHERE r <= 10) AS rel, {_CONF} AS conf, any_value([0.8, 1.0, 0.5, 0.35, 0.5][1 + query_id % 5]::DOUBLE) AS cov
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM contexts) GROUP BY query_id)"""


@query("j4_overall", with_inputs(_EVAL))
def _(spark, sf):
    return loop.evaluate(inputs.contexts(spark, sf), _judged(spark, sf))


_TEXTS = "SELECT query_id, string_agg(content, ' ' ORDER BY rank) AS context_text FROM (SELECT query_id, rank, content FROM contexts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5) GROUP BY query_id"
# the name pattern needs a look-ahead, so separators are doubled and consumed instead
_NAMES = r"list_filter(regexp_extract_all(regexp_replace(question, '([^\p{L}\p{N}_-])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])([A-Z][a-zA-Z0-9-]*)(?:$|[^a-zA-Z0-9-])', 1), lambda x: length(x) > 1)"
_GAPS = f"""SELECT query_id, overall, concat_ws('|', CASE WHEN n_contexts < 3 THEN 'insufficient_contexts' END, CASE WHEN overall < 0.7 THEN 'low_quality' END,
    CASE WHEN {contains_any('question', v.GAP_NUMBER_WORDS)} AND len(list_filter(regexp_extract_all(context_text, '[0-9]+\\.?[0-9]*'), lambda x: contains(x, '.') OR x::DOUBLE > 1)) < 2 THEN 'missing_numerical_values' END,
    CASE WHEN {contains_any('question', v.GAP_COMPARISON_WORDS)} AND len(names) >= 2 AND len(list_filter(names, lambda x: NOT contains(lower(context_text), lower(x)))) > 0 THEN 'missing_comparison_data' END,
    CASE WHEN {contains_any('question', v.GAP_ENTITY_WORDS)} AND len(list_filter(regexp_split_to_array(context_text, '\\s+'), lambda x: x <> '')) < 50 THEN 'missing_entities' END,
    CASE WHEN {contains_any('question', v.GAP_RELATION_WORDS)} AND NOT {contains_any('context_text', v.CAUSAL_WORDS)} THEN 'missing_relationships' END) AS gaps
    FROM (SELECT *, {_NAMES} AS names FROM evals JOIN texts USING (query_id) JOIN questions ON item_id = query_id)"""


def _gap_rows(spark, sf):
    c = inputs.contexts(spark, sf)
    rows = loop.evaluate(c, _judged(spark, sf)).join(loop.first_texts(c), "query_id").join(_questions(spark, sf), "query_id")
    return rows.select("query_id", "overall", loop.gaps(F.col("question"), F.col("context_text"), F.col("n_contexts"), F.col("overall")).alias("gaps"))


@query("j5_gaps", with_inputs("SELECT query_id, gaps FROM gapped", evals=_EVAL, texts=_TEXTS, gapped=_GAPS))
def _(spark, sf):
    return _gap_rows(spark, sf).select("query_id", F.array_join("gaps", "|").alias("gaps"))


_ACTION = """CASE WHEN overall >= 0.7 THEN 'generate' WHEN contains(gaps, 'insufficient_contexts') OR contains(gaps, 'low_quality') THEN 'reformulate_query'
    WHEN contains(gaps, 'missing_entities') OR contains(gaps, 'missing_relationships') THEN 'enhance_kg_query' WHEN contains(gaps, 'missing_numerical_values') OR contains(gaps, 'missing_comparison_data') THEN 'expand_retrieval'
    ELSE 'reformulate_query' END"""


@query("j6_recommended_action", with_inputs(f"SELECT query_id, {_ACTION} AS action FROM gapped", evals=_EVAL, texts=_TEXTS, gapped=_GAPS))
def _(spark, sf):
    return _gap_rows(spark, sf).select("query_id", loop.recommended_action(F.col("overall"), F.col("gaps")).alias("action"))


@query(
    "j7_stop_reason",
    with_inputs("SELECT model, mode, question_id, CASE WHEN quality_score >= 0.9 THEN 'early_stop' WHEN quality_score >= 0.7 THEN 'quality_sufficient' WHEN iterations >= 3 THEN 'max_iterations' END AS stop FROM eval_runs"),
)
def _(spark, sf):
    r = inputs.eval_runs(spark, sf)
    return r.select("model", "mode", "question_id", loop.stop_reason(F.col("quality_score"), F.col("iterations")).alias("stop"))


def _rounds(spark, sf):
    """Every round embeds the question as rewritten and is judged by how near its contexts are."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    corpus = cut_lineage(vectors.hashed_embedding(docs, "content").select("vec_id", "embedding"))

    def retrieve(unfinished, round_no):
        asked = vectors.hashed_embedding(unfinished.select("query_id", "query"), "query").select("query_id", "embedding")
        near = vectors.top_k(asked, corpus, 30).join(unfinished.select("query_id", "top_k"), "query_id").filter(F.col("rank") <= F.col("top_k"))
        return near.join(docs, "vec_id").select(
            "query_id", F.col("vec_id").alias("doc_id"), "content", F.concat(F.lit("source_"), (F.col("vec_id") % 6).cast("string")).alias("source"),
            "similarity", F.lit(None).cast("double").alias("rerank_score"),
        )

    def judge(unfinished, contexts, round_no):
        near = contexts.filter("rank <= 5").groupBy("query_id").agg(F.bround(F.avg("similarity"), 2).alias("near"))
        return unfinished.select("query_id").join(near, "query_id", "left").select("query_id", F.coalesce("near", F.lit(0.0)).cast("string").alias("judge_answer"))

    return loop.retrieve_in_rounds(_questions(spark, sf), retrieve, judge, threshold=0.6)


@query("j8_retrieve_in_rounds")
def _(spark, sf):
    return _rounds(spark, sf)[1].withColumn("gaps", F.array_join("gaps", "|"))


@query(
    "j9_run_summary",
    with_inputs(
        """SELECT rounds, count(*) AS questions, round_even(avg(quality), 6) AS mean_quality, round_even(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM
        (SELECT model || mode || question_id AS query_id, iterations AS rounds, quality_score AS quality FROM eval_runs) GROUP BY rounds"""
    ),
)
def _(spark, sf):
    r = inputs.eval_runs(spark, sf)
    h = r.select(F.concat("model", "mode", F.col("question_id").cast("string")).alias("query_id"), F.col("iterations").alias("round"), F.col("quality_score").alias("overall"))
    return loop.run_summary(h)


@query(
    "j9_run_totals",
    with_inputs(
        """SELECT model, count(*) AS questions, count(*) FILTER (WHERE error IS NULL) AS succeeded, round_even(count(*) FILTER (WHERE error IS NULL) * 100 / count(*), 6) AS success_rate,
        round_even(avg(iterations) FILTER (WHERE error IS NULL), 6) AS mean_rounds, round_even(avg(quality_score) FILTER (WHERE error IS NULL), 6) AS mean_quality,
        round_even(avg(response_time) FILTER (WHERE error IS NULL), 6) AS mean_seconds FROM (SELECT *, 'all' AS model FROM (SELECT * EXCLUDE (model) FROM eval_runs)) GROUP BY model"""
    ),
)
def _(spark, sf):
    r = inputs.eval_runs(spark, sf).select(F.col("iterations").alias("rounds"), F.col("quality_score").alias("quality"), F.col("response_time").alias("seconds"), "error")
    return loop.run_totals(r, failed=F.col("error").isNotNull()).withColumn("model", F.lit("all"))


def _noted(spark, sf):
    """Contexts whose text carries measurements."""
    c = inputs.contexts(spark, sf).drop("content")
    p = inputs.papers(spark, sf).select("doc_id", F.col("text").alias("content"))
    return c.join(p, "doc_id")


_FOUND = f"""SELECT query_id, {concat_lists([find_all('p.text', u) for u in v.EVIDENCE_UNITS])} AS vals, {concat_lists([find_all('p.text', u, 1) for u in v.EVIDENCE_METHODS])} AS meths, question
    FROM contexts c JOIN papers p USING (doc_id) JOIN questions ON item_id = query_id"""
_ELEMENTS = f"""SELECT item_id AS query_id, coalesce(v, []) AS vals, coalesce(m, []) AS methods FROM questions
    LEFT JOIN (SELECT query_id, (list_sort(list_distinct(flatten(list(vals)))))[1:20] AS v FROM found WHERE {EXPECT_SQL['expects_numbers']} GROUP BY query_id) a ON a.query_id = item_id
    LEFT JOIN (SELECT query_id, (list_sort(list_distinct(flatten(list(meths)))))[1:10] AS m FROM found WHERE {EXPECT_SQL['expects_method']} GROUP BY query_id) b ON b.query_id = item_id"""


@query("k1_evidence_elements", with_inputs(f"SELECT query_id, {joined('vals')} AS vals, {joined('methods')} AS methods FROM elements", found=_FOUND, elements=_ELEMENTS))
def _(spark, sf):
    e = loop.evidence_elements(_noted(spark, sf), _questions(spark, sf), most_values=20, most_methods=10)
    return e.select("query_id", F.array_join("values", "|").alias("vals"), F.array_join("methods", "|").alias("methods"))


_ANSWER = "CASE query_id % 3 WHEN 0 THEN 'It reaches 25.2 % and 1.1 eV by thermal annealing' WHEN 1 THEN 'About 20 %' ELSE 'Unknown' END"


@query(
    "k2_check_answers",
    with_inputs(
        f"""SELECT query_id, concat_ws('|', i1, i2) AS issues, i1 IS NULL AND i2 IS NULL AS valid, round_even(1.0::DOUBLE - ((i1 IS NOT NULL)::INTEGER + (i2 IS NOT NULL)::INTEGER) * 0.3::DOUBLE, 6) AS confidence FROM
        (SELECT query_id, CASE WHEN {EXPECT_SQL['expects_numbers']} AND len(vals) > 0 AND n = 0 THEN 'Missing numerical values' WHEN {EXPECT_SQL['expects_numbers']} AND len(vals) > 0 AND {EXPECT_SQL['number_count']} > n
        THEN 'Too few numbers' END AS i1, CASE WHEN {EXPECT_SQL['expects_method']} AND len(methods) > 0 AND len(list_filter(methods, lambda m: contains(lower(answer), lower(m)))) = 0 THEN 'Missing specific method name' END AS i2
        FROM (SELECT *, len({concat_lists([find_all('answer', u) for u in v.ANSWER_UNITS])}) AS n FROM (SELECT *, {_ANSWER} AS answer FROM elements JOIN questions ON item_id = query_id)))""",
        found=_FOUND, elements=_ELEMENTS,
    ),
)
def _(spark, sf):
    q = _questions(spark, sf)
    e = loop.evidence_elements(_noted(spark, sf), q, most_values=20, most_methods=10)
    a = q.withColumn("answer", inputs.choose(F.col("query_id") % 3, ["It reaches 25.2 % and 1.1 eV by thermal annealing", "About 20 %", "Unknown"]))
    return loop.check_answers(a, e).select("query_id", F.array_join("issues", "|").alias("issues"), "valid", "confidence")
