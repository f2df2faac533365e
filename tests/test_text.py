import re

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions import names as nm
from paperloom.functions import questions as qs
from paperloom.functions import scores as sc
from paperloom.functions import tagging
from paperloom.functions import text as tx
from paperloom.operators import chunking, kg_build
from paperloom.sources import readers, writers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def apply(spark, fn, *values):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.select(fn(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_formula_numbers_are_closed_in_a_single_pass(spark):
    got = apply(spark, tx.repair_formula_numbers, "a $1 9 . 2 0 \\%$ b", "$1 9 2$", "no 1 2", "$1 0 - 2 0$ and $3 . 5$", "$$x$$ 1 2")
    assert got == ["a $19.20\\%$ b", "$19 2$", "no 1 2", "$10-20$ and $3.5$", "$$x$$ 1 2"]


def test_clean_document_text_keeps_one_blank_line(spark):
    assert apply(spark, tx.clean_document_text, " a \r\n\r\n \n\t b \rc ") == ["a\n\nb\nc"]


def test_markdown_title_and_ids(spark):
    assert apply(spark, tx.markdown_title, "x\n  # A title \n# other", "none") == ["A title", "Unknown Title"]
    assert apply(spark, tx.paper_id, "A b(c): d-é") == ["A_bc_d-é"]
    assert apply(spark, tx.category_slug, "Stability & Degradation") == ["stability_degradation"]


def test_html_helpers(spark):
    page = '<a class="result__a" href="//s.example/l/?uddg=https%3A%2F%2Fa.b%2Fc%3Fx%3D1&amp;rut=2">A <b>B</b> &amp; C</a><a href="/x">x</a>'
    assert one(spark, x=tx.html_links(F.lit(page), "result__a")).x == [("https://a.b/c?x=1", "A B & C")]
    assert apply(spark, tx.strip_answer_footer, "yes\n\n[Sources: 5 vector docs]", "no\n[NO SOURCES]") == ["yes", "no"]


def test_tags_of_the_worked_example(spark):
    text = "Crystals made by the vapor-diffusion method reached PLQYs of 98% and 99%, a PCE of 25.2% and 1.15 V, higher than before."
    r = one(spark, **{n: c for n, c in tagging.tag_columns(F.lit(text)).items()})
    assert r.has_numerical_data and r.has_methods and r.has_comparisons
    assert r.numerical_values[:3] == ["98%", "99%", "25.2%"]
    assert r.key_metrics == ["PCE"]
    assert r.content_density == "high"


def test_word_boundaries_are_unicode_aware(spark):
    assert apply(spark, tagging.key_metrics, "éPCE", "PCE.") == [[], ["PCE"]]


def test_sections_and_windows(spark):
    body = "word " * 400
    text = "Some preamble that is long enough to be kept as a section of its own.\n# Abstract\n" + body + "\n## 2. Introduction\nshort\n# References\n[1] A. Author, something that is long enough to be a section"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    s = chunking.section_rows(df).orderBy("section_no").collect()
    assert [r.section_type for r in s] == ["default", "abstract", "references"]
    p = chunking.passages(df).orderBy("global_chunk_id").collect()
    assert {r.section_type for r in p} == {"default", "abstract"}
    assert {r.total_chunks for r in p} == {len(p)}
    abstract = next(r.text for r in s if r.section_type == "abstract")
    windows = [r for r in p if r.section_type == "abstract"]
    assert [r.chunk_start_pos for r in windows] == list(range(0, len(abstract), 600))
    rebuilt = ""
    for r in windows:
        rebuilt += abstract[len(rebuilt) : r.chunk_end_pos]
        assert r.content == abstract[r.chunk_start_pos : r.chunk_end_pos].strip()
    assert rebuilt == abstract


def test_tail_window_is_still_emitted(spark):
    r = one(spark, w=chunking.windows(F.lit("x" * 1700), F.lit(1000), F.lit(250)))
    assert [(w.start, w.end) for w in r.w] == [(0, 1000), (750, 1700), (1500, 1700)]


def test_strict_headings(spark):
    df = spark.createDataFrame([("Analysis of everything shows that all is well with this long sentence.\n" * 2,)], "text string")
    assert [r.section_type for r in chunking.section_rows(df).collect()] == ["discussion", "discussion"]
    assert [r.section_type for r in chunking.section_rows(df, strict_headings=True).collect()] == ["default"]


def test_names(spark):
    assert apply(spark, nm.normalize_name, "PCE", "open circuit-voltage", "$V_{oc}$", "MAPbI3", "TiO2") == [
        "Power Conversion Efficiency", "Open-Circuit Voltage", "Open-Circuit Voltage", "Methylammonium Lead Iodide", "TiO2",
    ]
    a = one(spark, a=nm.entity_id(F.lit("PCE"), F.lit("Metric")), b=nm.entity_id(F.lit("power conversion efficiency"), F.lit("Metric")))
    assert a.a == a.b and a.a.startswith("Metric_") and len(a.a) == 19
    assert one(spark, x=nm.same_entity(F.lit("PCE"), F.lit("Fill Factor"))).x is False


def test_questions(spark):
    r = one(spark, t=qs.key_terms(F.lit("What is the PCE of ITO and pce films")), c=qs.query_class(F.lit("Show me latest work")), s=qs.select_sources(F.lit("Compare a and b"), 1))
    assert r.t == ["what", "Power Conversion Efficiency", "Indium Tin Oxide", "films"]
    assert r.c == "latest" and r.s == ["vector", "kg", "reranker"]


def test_scores_keep_missing_values_missing(spark):
    assert apply(spark, sc.parse_score, "0.8", "Score: 7/10", "I give 0.65", "none", "", "-3") == [0.8, 1.0, 0.65, None, None, 0.0]
    assert apply(spark, lambda c: sc.parse_score(c, "first"), "first 0.4 then 0.9") == [0.4]


def test_json_repair(spark):
    raw = [
        'text\n```json\n{"entities": [{"name": "a", "type": "Metric",}],}\n```',
        '{{"entities": [{{"name": "b{{c}}", "type": "x"}}]}}',
        '{"entities": [{"name": "$\\mathrm{x}$", "type": "y"}]}',
        '{"entities": [{"name": "c", "properties": {"k": {"j": 1}}}]}',
        "There are no entities here",
        "free text",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, response string")
    rows = kg_build.parse_responses(df).orderBy("i").collect()
    names = [r.parsed.entities[0].name if r.parsed and r.parsed.entities else None for r in rows]
    assert names == ["a", "b{{c}}", "$\\mathrm{x}$", "c", None, None]


def test_encodings_and_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("naïve\r\ntext".encode())
    (tmp_path / "sub" / "b.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "c.md").write_bytes(b"  \n")
    (tmp_path / "d.csv").write_bytes(b"x")
    rows = {r.filename: r for r in readers.scan_documents(spark, str(tmp_path)).collect()}
    assert {k: r.content for k, r in rows.items()} == {"a.md": "naïve\ntext", "b.txt": "中文"}
    assert rows["b.txt"].relative_path == "sub/b.txt" and rows["b.txt"].extension == ".txt" and rows["a.md"].file_size == 12


def test_question_headers_and_references(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Question,Expected Answer,ID\n"What, now?",yes,1\n,no,2\n')
    rows = readers.load_questions(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.question, r.expected_answer, r.paper_reference, r.question_id) for r in rows] == [("What, now?", "yes", "N/A", "1")]
    ref = 'T: a: Sec 2, Excerpt: "the words"'
    r = readers.with_reference_parts(spark.createDataFrame([(ref, "e"), ("Plain", "e")], "paper_reference string, expected_answer string")).collect()
    assert (r[0].document_title, r[0].location, r[0].ground_truth) == ("T", "a: Sec 2", "the words")
    assert (r[1].document_title, r[1].location, r[1].ground_truth) == ("Plain", "", "e")


def test_bad_json_files_are_kept_as_corrupt(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"paper_id": "p1", "qa_pairs": [{"question": "q", "answer": "a"}]}')
    (tmp_path / "p2.json").write_text("{broken")
    files = readers.scan_qa_files(spark, str(tmp_path)).cache()
    assert files.filter(F.col("_corrupt_record").isNotNull()).count() == 1
    assert [r.question for r in readers.explode_items(files, "qa_pairs").collect()] == ["q"]


def test_null_safe(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "i int, x double")
    assert [r.x for r in writers.null_safe(df).orderBy("i").collect()] == [None, None, 0.5]


def test_patterns_are_shared_by_both_engines():
    for family in v.SECTION_HEADINGS:
        re.compile(v.heading_pattern(family).replace(r"\p{L}\p{N}", r"\w"))


def test_hints_compute_what_they_are_given_once():
    c = F.expr("concat(content, 'x')")
    for made in (tagging.extraction_hints(F.array(c)), tagging.content_types(c), tagging.words_found(c, ["a", "b"])):
        assert str(made).count("content") == 1
    # methods, metrics and five patterns of values
    assert str(tagging.content_hints(c)).count("content") == 7


def test_content_types_see_words_in_any_case(spark):
    got = apply(spark, tagging.content_types, "SVM and PCE", "Perovskite", "none", None)
    assert got == [["ML_Algorithm", "Metric"], ["Material"], [], []]


def test_one_large_row_group_is_dealt_out(spark, tmp_path):
    path, n = str(tmp_path / "t"), spark.sparkContext.defaultParallelism
    spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("x")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        read = spark.read.parquet(path)
        assert read.rdd.getNumPartitions() >= n
        rows = readers.spread(read)
        most = max(rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert most < 20_000 / 4 and rows.count() == 20_000


def test_files_are_written_flat_and_cleaned_once(spark, tmp_path):
    path = str(tmp_path / "files")
    rows = spark.range(50).select("id", F.concat(F.col("id").cast("string"), F.lit("\n a \r\n b")).alias("value"))
    writers.write_file_per_row(rows, ["id"], path, "text")
    files = list((tmp_path / "files").rglob("*.txt"))
    assert len(files) == 50 and {f.parent for f in files} == {tmp_path / "files"}
    found = readers.scan_documents(spark, path)
    assert {r.content for r in found.collect()} == {f"{i}\na\nb" for i in range(50)}
    # one pass decodes and cleans: a second one for the filter would call Python again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
