"""What the questions of a whole table ask for."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions import questions as qs
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import contains_any, joined, matches, s, with_inputs

Q = "question"


def _case(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {s(label)}" for label, test in rules) + f" ELSE {s(default)} END"


TYPE_SQL = _case([(label, contains_any(Q, words)) for label, words in v.QUESTION_TYPES], "general")
CLASS_SQL = _case([(label, matches(f"lower({Q})", qs.whole_words(words), "")) for label, words in v.QUERY_CLASSES], "general")
NEEDS_SQL = {n: contains_any(Q, words) for n, words in v.INFORMATION_NEEDS.items()}


@query("h1_question_type", with_inputs(f"SELECT item_id, {TYPE_SQL} AS question_type FROM questions"))
def _(spark, sf):
    return inputs.questions(spark, sf).select("item_id", qs.question_type(F.col(Q)).alias("question_type"))


@query("h1_turn_type", with_inputs("SELECT conv_id, turn, " + TYPE_SQL.replace(Q, "text") + " AS question_type FROM conversations"))
def _(spark, sf):
    from paperloom.sources.readers import table

    return table(spark, sf, "conversations").select("conv_id", "turn", qs.question_type(F.col("text")).alias("question_type"))


@query("h2_query_class", with_inputs(f"SELECT item_id, {CLASS_SQL} AS query_class FROM questions"))
def _(spark, sf):
    return inputs.questions(spark, sf).select("item_id", qs.query_class(F.col(Q)).alias("query_class"))


@query("h3_information_needs", with_inputs(f"SELECT item_id, {', '.join(f'{e} AS {n}' for n, e in NEEDS_SQL.items())} FROM questions"))
def _(spark, sf):
    return inputs.questions(spark, sf).select("item_id", *[c.alias(n) for n, c in qs.information_needs(F.col(Q)).items()])


def _pick(a, b, c, d) -> str:
    return f"CASE WHEN {NEEDS_SQL['numerical_question']} THEN {a} WHEN {NEEDS_SQL['method_question']} THEN {b} WHEN {NEEDS_SQL['comparison_question']} THEN {c} ELSE {d} END"


@query(
    "h4_retrieval_parameters",
    with_inputs(
        f"""SELECT item_id, {_pick(20, 15, 20, 20)} AS vector_top_k, {_pick(8, 5, 8, 8)} AS reranker_top_n, 10 AS kg_max_entities,
        {_pick(*[s('|'.join(v.PRIORITY_SECTIONS[n])) for n in ('numerical_question', 'method_question', 'comparison_question')], "''")} AS prioritize_sections FROM questions"""
    ),
)
def _(spark, sf):
    p = qs.retrieval_parameters(F.col(Q))
    p["prioritize_sections"] = F.array_join(p["prioritize_sections"], "|")
    return inputs.questions(spark, sf).select("item_id", *[c.alias(n) for n, c in p.items()])


@query(
    "h5_select_sources",
    with_inputs(
        f"""SELECT item_id, concat_ws('|', 'vector', 'kg', 'reranker', CASE WHEN {CLASS_SQL} IN ('latest', 'definition', 'general')
        OR {matches(f'lower({Q})', qs.whole_words(dict(v.QUERY_CLASSES)['latest']), '')} THEN 'web' END) AS sources FROM questions"""
    ),
)
def _(spark, sf):
    return inputs.questions(spark, sf).select("item_id", F.array_join(qs.select_sources(F.col(Q)), "|").alias("sources"))


_FULL = "MAP {" + ", ".join(f"{s(k)}: {s(n[0])}" for k, n in v.ABBREVIATIONS.items()) + "}"
_TOKENS = f"regexp_extract_all(lower({Q}), {s(v.WORDS)})"
_TERMS = f"list_filter(list_transform({_TOKENS}, lambda w: coalesce({_FULL}[w], CASE WHEN length(w) > 3 THEN w END)), lambda t: t IS NOT NULL)"
KEY_TERMS_SQL = "list_filter(t, lambda e, i: list_position(list_transform(t, lambda y: lower(y)), lower(e)) = i)"


@query(
    "h6_query_expansion",
    with_inputs(
        f"""SELECT item_id, {joined('terms')} AS key_terms, CASE WHEN len(names) > 0 THEN question || ' ' || array_to_string(names, ' ') ELSE question END AS expanded,
        CASE WHEN len(terms) > 0 THEN question || ' ' || array_to_string(terms, ' ') ELSE question END AS enhanced FROM
        (SELECT item_id, question, {KEY_TERMS_SQL} AS terms, names FROM (SELECT item_id, question, {_TERMS} AS t, list_filter(list_transform({_TOKENS}, lambda w: {_FULL}[w]), lambda x: x IS NOT NULL) AS names FROM questions))"""
    ),
)
def _(spark, sf):
    c = F.col(Q)
    return inputs.questions(spark, sf).select(
        "item_id", F.array_join(qs.key_terms(c), "|").alias("key_terms"), qs.expand_abbreviations(c).alias("expanded"), qs.enhanced_query(c).alias("enhanced")
    )


EXPECT_SQL = {
    "expects_numbers": contains_any(Q, v.EXPECT_NUMBERS),
    "expects_method": contains_any(Q, v.EXPECT_METHOD),
    "expects_comparison": contains_any(Q, v.EXPECT_COMPARISON),
    "number_count": f"CASE WHEN {contains_any(Q, v.EXPECT_COMPARISON)} OR ({contains_any(Q, v.EXPECT_NUMBERS)} AND {contains_any(Q, v.EXPECT_SEVERAL)}) THEN 2 ELSE 0 END",
}


@query("h7_answer_expectations", with_inputs(f"SELECT item_id, {', '.join(f'{e} AS {n}' for n, e in EXPECT_SQL.items())} FROM questions"))
def _(spark, sf):
    return inputs.questions(spark, sf).select("item_id", *[c.alias(n) for n, c in qs.answer_expectations(F.col(Q)).items()])
