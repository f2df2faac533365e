"""Sections, passages and passage tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions import tagging
from paperloom.operators import chunking
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import concat_lists, contains_any, distinct_in_order, find_all, joined, matches, s, strip, sub, with_inputs

_FIELDS = (
    "doc_id, global_chunk_id, total_chunks, section_type, section_title, section_name, section_priority, section_chunk_id, "
    "section_chunks_count, chunk_size, token_count, is_complete_section, chunk_start_pos, chunk_end_pos, configured_chunk_size, configured_overlap"
)


@query("c1_identify_sections", with_inputs("SELECT doc_id, section_no, section_type, section_title, md5(text) AS text_md5 FROM sections"))
def _(spark, sf):
    return chunking.section_rows(inputs.papers(spark, sf).select("doc_id", "text")).select(
        "doc_id", "section_no", "section_type", "section_title", F.md5("text").alias("text_md5")
    )


@query(
    "c2_section_lengths",
    with_inputs("SELECT section_type, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest FROM sections GROUP BY section_type"),
)
def _(spark, sf):
    return chunking.section_rows(inputs.papers(spark, sf).select("doc_id", "text")).groupBy("section_type").agg(
        F.count("*").alias("n"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest")
    )


@query(
    "c3_skipped_references",
    with_inputs("SELECT count(*) FILTER (WHERE section_type = 'references') AS skipped, count(*) FILTER (WHERE section_type <> 'references') AS kept FROM sections"),
)
def _(spark, sf):
    return chunking.skipped_references(chunking.section_rows(inputs.papers(spark, sf).select("doc_id", "text")))


@query(
    "c4_windows",
    """SELECT doc_id, start AS start_pos, least(start + 1000, n) AS end_pos FROM (SELECT doc_id, length(text) AS n,
    unnest(CASE WHEN length(text) <= 1000 THEN [0::BIGINT] ELSE range(0, length(text), 750) END) AS start FROM documents)""",
)
def _(spark, sf):
    from paperloom.sources.readers import table

    d = table(spark, sf, "documents").select("doc_id", F.explode(chunking.windows(F.col("text"), F.lit(1000), F.lit(250))).alias("w"))
    return d.select("doc_id", F.col("w.start").alias("start_pos"), F.col("w.end").alias("end_pos"))


@query(
    "c5_section_configuration",
    with_inputs(
        "SELECT section_type, configured_chunk_size, configured_overlap, section_priority, section_name, max(chunk_size) AS largest, count(*) AS n FROM passages GROUP BY ALL"
    ),
)
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    return p.groupBy("section_type", "configured_chunk_size", "configured_overlap", "section_priority", "section_name").agg(
        F.max("chunk_size").alias("largest"), F.count("*").alias("n")
    )


@query("c6_passages", with_inputs(f"SELECT {_FIELDS}, md5(content) AS content_md5 FROM passages"))
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    return p.withColumn("content_md5", F.md5("content")).drop("content")


_STATS = """count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS characters, round(avg(length(content)), 6) AS avg_chunk_size, CAST(sum(token_count) AS BIGINT) AS tokens,
round(avg(token_count), 6) AS avg_tokens, CAST(sum(chunk_size) AS BIGINT) AS covered, count(*) FILTER (WHERE is_complete_section) AS complete_sections,
max(configured_chunk_size) AS configured_chunk_size, max(configured_overlap) AS configured_overlap"""


@query("c7_chunk_stats", with_inputs(f"SELECT section_type, {_STATS} FROM passages GROUP BY ROLLUP(section_type)"))
def _(spark, sf):
    return chunking.chunk_stats(chunking.passages(inputs.papers(spark, sf).select("doc_id", "text")))


@query(
    "c8_section_summary",
    with_inputs(
        """SELECT section_name, section_type, section_priority, count(*) AS chunks, CAST(sum(chunk_size) AS BIGINT) AS total_size, CAST(sum(token_count) AS BIGINT) AS total_tokens,
        max(configured_chunk_size) AS configured_chunk_size, max(configured_overlap) AS configured_overlap, CAST(sum(chunk_size) // count(*) AS BIGINT) AS mean_size
        FROM passages GROUP BY ALL"""
    ),
)
def _(spark, sf):
    return chunking.section_summary(chunking.passages(inputs.papers(spark, sf).select("doc_id", "text")))


# --- tags --------------------------------------------------------------------------------------------------------
def _tag_query(name: str, column: str, sql: str, build):
    @query(name, with_inputs(f"SELECT doc_id, global_chunk_id, {sql} AS {column} FROM passages"))
    def _(spark, sf):
        p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
        return p.select("doc_id", "global_chunk_id", build(F.col("content")).alias(column))


NUMERIC_SQL = matches("content", tagging.NUMBER_PATTERN)
METHODS_SQL = contains_any("content", v.METHOD_STEMS)
COMPARE_SQL = contains_any("content", v.COMPARISON_STEMS)
VALUES_SQL = joined(f"({distinct_in_order(concat_lists([find_all('content', p) for p in v.NUMBER_UNITS]))})[1:{v.MAX_NUMBERS}]")
METRICS_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN {matches('content', v.WORD_START + p + v.WORD_END)} THEN {s(n)} END" for n, p in v.METRIC_PATTERNS
) + ")"
_doubled = sub("content", r"([^\p{L}\p{N}_])", r"\1\1")
TERMS_SQL = joined(
    "list_sort(list_distinct(list_filter("
    + concat_lists(
        [find_all("content", v.WORD_START + "(" + v.FORMULA_SHAPE + ")", 1)]
        + [find_all(_doubled, f"{v.WORD_START}({t}){v.WORD_END}", 1) for t in v.MATERIAL_TERMS]
    )
    + f", lambda t: length(t) > 2)))[1:{v.MAX_TERMS}]"
)
_kinds = " + ".join(f"CAST({matches('content', p)} AS INTEGER)" for p in v.NUMBER_UNITS)
DENSITY_SQL = (
    f"CASE WHEN length(content) = 0 THEN 'low' WHEN ({_kinds}) / (length(content) / 1000) > 5 THEN 'high' "
    f"WHEN ({_kinds}) / (length(content) / 1000) > 2 THEN 'medium' ELSE 'low' END"
)

_tag_query("d1_has_numerical_data", "has_numerical_data", NUMERIC_SQL, tagging.has_numerical_data)
_tag_query("d2_has_methods", "has_methods", METHODS_SQL, tagging.has_methods)
_tag_query("d3_has_comparisons", "has_comparisons", COMPARE_SQL, tagging.has_comparisons)
_tag_query("d4_numerical_values", "numerical_values", VALUES_SQL, lambda c: F.array_join(tagging.numerical_values(c), "|"))
_tag_query("d5_key_metrics", "key_metrics", METRICS_SQL, lambda c: F.array_join(tagging.key_metrics(c), "|"))
_tag_query("d6_technical_terms", "technical_terms", TERMS_SQL, lambda c: F.array_join(tagging.technical_terms(c), "|"))
_tag_query("d7_content_density", "content_density", DENSITY_SQL, tagging.content_density)


@query(
    "d8_tag_coverage",
    with_inputs(
        f"""SELECT count(*) AS passages, count(*) FILTER (WHERE {NUMERIC_SQL}) AS with_numbers, count(*) FILTER (WHERE {METHODS_SQL}) AS with_methods,
        count(*) FILTER (WHERE {COMPARE_SQL}) AS with_comparisons FROM passages"""
    ),
)
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    c = F.col("content")
    return p.agg(
        F.count("*").alias("passages"),
        F.count_if(tagging.has_numerical_data(c)).alias("with_numbers"),
        F.count_if(tagging.has_methods(c)).alias("with_methods"),
        F.count_if(tagging.has_comparisons(c)).alias("with_comparisons"),
    )


_marks = " + ".join(f"CAST({matches(strip('lower(text)'), p)} AS INTEGER)" for p in v.REFERENCE_MARKS)
_lines = "string_split(text, chr(10))"
_entry = (
    f"list_filter(list_transform({_lines}, lambda x: {strip('x')}), lambda x: length(x) > 10 AND ({matches('x', v.REFERENCE_LINE[0], '')} OR {matches('x', v.REFERENCE_LINE[1], '')} "
    f"OR ({matches('x', v.REFERENCE_LINE_YEAR, '')} AND {matches('x', v.REFERENCE_LINE_NAME, '')})))"
)


def reference_sql(section: str = "section_type") -> str:
    return f"""({section} = 'references' OR (length({strip('lower(text)')}) >= 50 AND (({_marks}) / {len(v.REFERENCE_MARKS)} > 0.3
    OR len({find_all('text', v.CITATION, 0, '')}) > 3 OR (len({_lines}) > 5 AND len({_entry}) / len({_lines}) > 0.5))))"""


@query("d9_reference_content", with_inputs(f"SELECT doc_id, section_no, {reference_sql()} AS is_reference FROM sections"))
def _(spark, sf):
    rows = chunking.section_rows(inputs.papers(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", "section_no", tagging.is_reference_content(F.col("text"), F.col("section_type")).alias("is_reference"))


def _words_sql(words: list[str], column: str = "content") -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN contains(lower({column}), {s(w)}) THEN {s(w)} END" for w in words) + ")"


@query(
    "d10_domain_content",
    with_inputs(
        f"""SELECT doc_id, global_chunk_id, {_words_sql(v.ML_KEYWORDS)} AS ml_keywords, {_words_sql(v.PERFORMANCE_KEYWORDS)} AS metric_keywords,
        {joined(concat_lists([find_all('content', rf'([0-9]+\.?[0-9]*)\s*{u}', 1, '') for u in v.METRIC_VALUE_UNITS]))} AS numerical_values FROM passages"""
    ),
)
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    c = F.col("content")
    return p.select(
        "doc_id", "global_chunk_id",
        F.array_join(tagging.words_found(c, v.ML_KEYWORDS), "|").alias("ml_keywords"),
        F.array_join(tagging.words_found(c, v.PERFORMANCE_KEYWORDS), "|").alias("metric_keywords"),
        F.array_join(tagging.metric_values(c), "|").alias("numerical_values"),
    )


@query(
    "d11_extraction_hints",
    with_inputs(
        f"""SELECT doc_id, global_chunk_id, concat_ws('|', CASE WHEN ml AND metric THEN 'PREDICTS' END, CASE WHEN material AND metric THEN 'HAS_PROPERTY' END,
        CASE WHEN process AND metric THEN 'INFLUENCES' END) AS hints FROM (SELECT doc_id, global_chunk_id, {contains_any('content', v.ML_KEYWORDS)} AS ml,
        {contains_any('content', v.PERFORMANCE_KEYWORDS)} AS metric, {contains_any('content', ['perovskite', 'silicon'])} AS material,
        {contains_any('content', v.NAME_KEYWORDS['Process'])} AS process FROM passages)"""
    ),
)
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    types = tagging.content_types(F.col("content"))
    return p.select("doc_id", "global_chunk_id", F.array_join(tagging.extraction_hints(types), "|").alias("hints"))


def _found_sql(words: list[str]) -> str:
    return "list_filter([" + ", ".join(s(w) for w in words) + "], lambda w: contains(lower(content), w))"


@query(
    "d11_content_hints",
    with_inputs(
        f"""SELECT doc_id, global_chunk_id, CASE WHEN len(ml) + len(metrics) > 0 THEN concat_ws(chr(10), CASE WHEN len(ml) > 0 THEN 'methods: ' || array_to_string(ml[1:5], ', ') END,
        CASE WHEN len(metrics) > 0 THEN 'metrics: ' || array_to_string(metrics[1:5], ', ') END, CASE WHEN n > 0 THEN 'values: ' || n END) END AS hints FROM
        (SELECT doc_id, global_chunk_id, {_found_sql(v.ML_KEYWORDS)} AS ml, {_found_sql(v.PERFORMANCE_KEYWORDS)} AS metrics,
        {" + ".join(f"len(regexp_extract_all(content, {s(rf'([0-9]+{chr(92)}.?[0-9]*){chr(92)}s*{u}')}))" for u in v.METRIC_VALUE_UNITS)} AS n FROM passages)"""
    ),
)
def _(spark, sf):
    p = chunking.passages(inputs.papers(spark, sf).select("doc_id", "text"))
    return p.select("doc_id", "global_chunk_id", tagging.content_hints(F.col("content"), shown=5).alias("hints"))
