"""Scans, sinks and round trips through files that Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import clean_document_text
from paperloom.functions.text import strip as strip_text
from paperloom.operators.chunking import passages
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import OPEN, CLOSE, joined, s, strip, sub, with_inputs
from paperloom.session import new_path
from paperloom.sources import readers, writers
from paperloom.sources.readers import spread, table


def repaired_sql(x: str) -> str:
    e = f"split_part(e, {s(CLOSE)}, 1)"
    for pattern, new in ((r"([0-9])\s+([0-9])", r"\1\2"), (r"([0-9])\s+(\.)", r"\1\2"), (r"(\.)\s+([0-9])", r"\1\2"),
                         (r"([0-9])\s+(\\%)", r"\1\2"), (r"([0-9])\s+(-)\s+([0-9])", r"\1\2\3")):
        e = sub(e, pattern, new)
    pieces = f"string_split({sub(x, r'\$([^$]+)\$', OPEN + chr(92) + '1' + CLOSE)}, {s(OPEN)})"
    return (
        f"array_to_string(list_transform({pieces}, lambda e, i: CASE WHEN i = 1 THEN e ELSE concat('$', {e}, '$', "
        f"split_part(e, {s(CLOSE)}, 2)) END), '')"
    )


def cleaned_sql(x: str) -> str:
    c = repaired_sql(sub(strip(x), r"\r\n?", "\n"))
    c = sub(c, rf"[{v.LINE_SPACE}]*\n[{v.LINE_SPACE}]*", "\n")
    return strip(sub(c, r"\n{3,}", "\n\n"))


@query("a1_scan_documents", f"SELECT doc_id, md5({cleaned_sql('text')}) AS content_md5 FROM documents WHERE length({strip('text')}) > 0")
def _(spark, sf):
    """One file per document in one folder; its first line is the document's number."""
    path = new_path(spark, "corpus")
    value = F.concat(F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    writers.write_file_per_row(table(spark, sf, "documents").select("doc_id", value.alias("value")), ["doc_id"], path, "text")
    found = readers.scan_documents(spark, path)
    doc, body = F.substring_index("content", "\n", 1), strip_text(F.regexp_replace("content", r"^[^\n]*\n?", ""))
    rows = found.select(doc.cast("bigint").alias("doc_id"), body.alias("body")).filter(F.length("body") > 0)
    return rows.select("doc_id", F.md5("body").alias("content_md5"))


@query(
    "a2_decode_fallback",
    r"""SELECT doc_id, length(t) AS chars, md5(t) AS text_md5 FROM
    (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'é ' || regexp_replace(text, '[^\x{00}-\x{ff}]', '?', 'g') ELSE text END AS t FROM documents)""",
)
def _(spark, sf):
    """A third of the texts as Latin-1 that neither UTF-8 nor GBK can read, because of their first word."""
    d = table(spark, sf, "documents")
    plain = F.concat(F.lit("é "), F.regexp_replace("text", r"[^\x00-\xff]", "?"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode(plain, "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    text = readers.decode_text(F.col("raw"))
    return spread(d.select("doc_id", raw.alias("raw"))).select("doc_id", text.alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    "a4_corpus_stats",
    "SELECT source, count(*) AS total_documents, CAST(sum(length(text)) AS BIGINT) AS total_characters, "
    "round(avg(length(text)), 6) AS avg_document_size FROM documents GROUP BY ROLLUP(source)",
)
def _(spark, sf):
    return readers.corpus_stats(table(spark, sf, "documents"), "text", "source")


@query(
    "a5_load_questions",
    "SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, 'N/A' AS expected_answer, 'N/A' AS paper_reference FROM benchmark",
)
def _(spark, sf):
    path = new_path(spark, "questions")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("Question ID"), F.col("text").alias("Validation Question"))
    b.write.option("header", "true").option("escape", '"').csv(path)
    return readers.load_questions(spark, path)


@query(
    "a5_questions_of_any_encoding",
    r"""SELECT CAST(item_id AS VARCHAR) AS question_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN '效率 ' ELSE 'é ' END || CASE WHEN item_id % 3 = 0 THEN '' ELSE regexp_replace(text, '[^\x00-\x7f]', '?', 'g') END AS question,
    CASE WHEN item_id % 3 = 1 THEN '答案 ' || item_id ELSE 'N/A' END AS expected_answer, 'N/A' AS paper_reference FROM benchmark""",
)
def _(spark, sf):
    """Three files: UTF-8, GBK with answers and other headers, and Latin-1."""
    path, i = new_path(spark, "questions"), F.col("item_id")
    b = table(spark, sf, "benchmark")
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", "?")
    parts = {
        "UTF-8": b.filter(i % 3 == 0).select(i.alias("Question ID"), F.col("text").alias("Validation Question")),
        "GBK": b.filter(i % 3 == 1).select(F.concat(F.lit("答案 "), i.cast("string")).alias("Expected Answer"), F.concat(F.lit("效率 "), plain).alias("Question"), i.alias("ID")),
        "ISO-8859-1": b.filter(i % 3 == 2).select(i.alias("question_id"), F.concat(F.lit("é "), plain).alias("Research_Question")),
    }
    charsets = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(charsets, "false")
    spark.conf.set(charsets, "true")  # only to make files in an encoding that Spark does not write otherwise
    try:
        for encoding, rows in parts.items():
            rows.write.mode("append").option("header", "true").option("escape", '"').option("encoding", encoding).csv(path)
    finally:
        spark.conf.set(charsets, before)
    return readers.load_questions(spark, path).select("question_id", "question", "expected_answer", "paper_reference")


@query("a6_sample_questions", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5")
def _(spark, sf):
    return readers.select_tests(table(spark, sf, "benchmark"), "first_n", "item_id", 5)


REFERENCE_SQL = (
    "concat('Paper ', item_id, CASE WHEN item_id % 4 = 0 THEN '' ELSE ': Section ' || (item_id % 7) END, "
    "CASE WHEN item_id % 5 = 0 THEN '' ELSE ', Excerpt: \"' || text || '\"' END)"
)


@query(
    "a7_parse_reference",
    f"""SELECT item_id, {strip("CASE WHEN contains(head, ': ') THEN split_part(head, ': ', 1) ELSE head END")} AS document_title,
    {strip("CASE WHEN contains(head, ': ') THEN substr(head, instr(head, ': ') + 2) ELSE '' END")} AS location,
    {strip(f"regexp_extract(ref, {s(v.EXCERPT)}, 1)")} AS excerpt,
    coalesce(nullif({strip(f"regexp_extract(ref, {s(v.EXCERPT)}, 1)")}, ''), 'expected') AS ground_truth
    FROM (SELECT item_id, ref, split_part(ref, ', Excerpt:', 1) AS head FROM (SELECT item_id, {REFERENCE_SQL} AS ref FROM benchmark))""",
)
def _(spark, sf):
    i = F.col("item_id")
    ref = F.concat(
        F.lit("Paper "), i.cast("string"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(": Section "), (i % 7).cast("string"))),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit(', Excerpt: "'), F.col("text"), F.lit('"'))),
    )
    b = table(spark, sf, "benchmark").select("item_id", ref.alias("paper_reference"), F.lit("expected").alias("expected_answer"))
    return readers.with_reference_parts(b).select("item_id", "document_title", "location", "excerpt", "ground_truth")


def _pair_files(spark, sf, items: str):
    """One file per paper; a long one goes on in further files, so that no group grows with its turns."""
    path = new_path(spark, "pairs")
    q = inputs.qa_pairs(spark, sf)
    if items == "qa_pairs":
        item = F.struct("question", "answer", "category", "difficulty", "reasoning_type")
    else:
        item = F.struct("category", F.col("answer").alias("content"), F.col("question").alias("evidence"))
    files = q.groupBy("paper_id", F.floor(F.col("pos") / 64).alias("part")).agg(F.collect_list(item).alias(items))
    writers.write_file_per_row(files, ["paper_id", "part"], path, "json")
    return path


@query(
    "a8_scan_qa_files",
    with_inputs("SELECT paper_id, question, md5(answer) AS answer_md5, category, difficulty, reasoning_type FROM qa_pairs"),
)
def _(spark, sf):
    files = readers.scan_qa_files(spark, _pair_files(spark, sf, "qa_pairs"))
    return readers.explode_items(files, "qa_pairs").select(
        "paper_id", "question", F.md5("answer").alias("answer_md5"), "category", "difficulty", "reasoning_type"
    )


@query("a9_scan_knowledge_files", with_inputs("SELECT paper_id, category, md5(answer) AS content_md5, md5(question) AS evidence_md5 FROM qa_pairs"))
def _(spark, sf):
    files = readers.scan_knowledge_files(spark, _pair_files(spark, sf, "knowledge_points"))
    return readers.explode_items(files, "knowledge_points").select(
        "paper_id", "category", F.md5("content").alias("content_md5"), F.md5("evidence").alias("evidence_md5")
    )


@query("a10_first_tests", "SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 20")
def _(spark, sf):
    return readers.select_tests(table(spark, sf, "benchmark"), "first_n", "item_id", 20)


@query("a10_random_tests", "SELECT item_id, text FROM benchmark ORDER BY md5(concat_ws('|', 42, item_id)), item_id LIMIT 20")
def _(spark, sf):
    return readers.select_tests(table(spark, sf, "benchmark"), "random", "item_id", 20, seed=42)


@query("a11_result_tree", with_inputs("SELECT model, category, mode, count(*) AS answers FROM eval_runs GROUP BY ALL"))
def _(spark, sf):
    path = new_path(spark, "results")
    runs = inputs.eval_runs(spark, sf)
    answer = F.struct(
        F.col("question_id").cast("string").alias("question_id"), "question", F.col("answer").alias("generated_answer"),
        "response_time", "iterations", "quality_score", "category", "error",
    )
    runs.select("model", F.col("category").alias("category_dir"), "mode", F.array(answer).alias("qa_results")).write.partitionBy(
        "model", "category_dir", "mode"
    ).json(path)
    found = readers.scan_result_tree(spark, path, "*.json", json_lines=True)
    return readers.result_inventory(found.withColumn("category", F.col("category_dir")))


@query(
    "a12_device_records",
    "SELECT record_id, donor, try_cast(nullif(trim(amount), '') AS DOUBLE) AS amount FROM (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS record_id, "
    "nullif(trim(CASE WHEN l_linenumber = 3 THEN '  ' ELSE ' ' || l_returnflag || ' ' END), '') AS donor, "
    "CASE l_linenumber WHEN 1 THEN ' ' WHEN 2 THEN 'n/a' ELSE ' ' || CAST(l_quantity AS INTEGER) END AS amount FROM lineitem) WHERE record_id IS NOT NULL",
)
def _(spark, sf):
    n = F.col("l_linenumber")
    raw = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("record_id"),
        F.when(n == 3, "  ").otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))).alias("donor"),
        F.when(n == 1, " ").when(n == 2, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"))).alias("amount"),
    )
    return readers.device_records(raw, ["amount"])


META_SQL = "SELECT count(*) AS total_qa_pairs, count(DISTINCT paper_id) AS total_papers FROM qa_pairs"


def _meta(q):
    return q.agg(F.count("*").alias("total_qa_pairs"), F.count_distinct("paper_id").alias("total_papers"))


@query("a13_export_json", with_inputs(f"SELECT p.paper_id, p.pos, p.question, m.total_qa_pairs, m.total_papers FROM qa_pairs p, ({META_SQL}) m"))
def _(spark, sf):
    path = new_path(spark, "export")
    q = inputs.qa_pairs(spark, sf)
    writers.write_json_document(q, _meta(q), path)
    meta = spark.read.schema("total_qa_pairs bigint, total_papers bigint").json(f"{path}/meta").first()
    back = spark.read.schema("paper_id string, pos bigint, question string").json(f"{path}/qa_pairs")
    return back.select("*", F.lit(meta[0]).alias("total_qa_pairs"), F.lit(meta[1]).alias("total_papers"))


@query("a14_export_json_lines", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, sf):
    path = new_path(spark, "lines")
    writers.write_json_lines(table(spark, sf, "conversations"), path)
    return spark.read.schema("conv_id bigint, turn bigint, role string, text string").json(path)


@query(
    "a15_export_by_category",
    with_inputs("SELECT category, count(*) AS pairs, replace(replace(lower(category), ' & ', '_'), ' ', '_') AS slug FROM qa_pairs GROUP BY category"),
)
def _(spark, sf):
    path = new_path(spark, "by-category")
    writers.write_by_category(inputs.qa_pairs(spark, sf), path)
    return spark.read.schema("category string, slug string").json(path).groupBy("category", "slug").agg(F.count("*").alias("pairs"))


@query("a16_passage_index", with_inputs("SELECT doc_id, global_chunk_id, md5(content) AS content_md5 FROM passages"))
def _(spark, sf):
    path = new_path(spark, "passages")
    writers.write_passage_index(passages(inputs.papers(spark, sf)), path)
    return spark.read.parquet(path).select("doc_id", "global_chunk_id", F.md5("content").alias("content_md5"))


@query("a17_graph_write", with_inputs("SELECT 'v' AS part, type, count(*) AS n FROM vertices GROUP BY type UNION ALL SELECT 'e', type, count(*) FROM edges GROUP BY type"))
def _(spark, sf):
    path = new_path(spark, "graph")
    writers.write_graph(inputs.trade_vertices(spark, sf), inputs.trade_edges(spark, sf), path)
    vs = spark.read.parquet(f"{path}/vertices").groupBy("type").agg(F.count("*").alias("n"))
    es = spark.read.parquet(f"{path}/edges").groupBy("type").agg(F.count("*").alias("n"))
    return vs.select(F.lit("v").alias("part"), "type", "n").unionByName(es.select(F.lit("e").alias("part"), "type", "n"))


@query("a18_report_files", with_inputs("SELECT model, mode, count(*) AS answers, round(avg(answer_correctness), 9) AS answer_correctness FROM eval_runs GROUP BY ALL"))
def _(spark, sf):
    path = new_path(spark, "report")
    r = inputs.eval_runs(spark, sf).groupBy("model", "mode").agg(
        F.count("*").alias("answers"), F.round(F.avg("answer_correctness"), 9).alias("answer_correctness")
    )
    writers.write_report(r, path, "csv")
    return spark.read.option("header", "true").schema("model string, mode string, answers bigint, answer_correctness double").csv(path)


@query(
    "a19_null_safe",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE value END AS value FROM events",
)
def _(spark, sf):
    e = F.col("event_id")
    raw = table(spark, sf, "events").select(
        "event_id",
        F.when(e % 7 == 0, float("nan")).when(e % 11 == 0, float("inf")).when(e % 13 == 0, float("-inf")).otherwise(F.col("value")).alias("value"),
    )
    return writers.null_safe(raw)
