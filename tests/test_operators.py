import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions import names as nm
from paperloom.operators import cellindex, components, evalcompare, evalscores, fusion, hooks, kg_build, kg_query, loop, qaset, vectors
from paperloom.plans import inputs
from paperloom.session import Steps, new_path
from paperloom.sources import readers
from paperloom.streaming import jobs


def vector_frames(spark, n=300, q=20, d=16, seed=3):
    rng = np.random.default_rng(seed)
    corpus = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)], "vec_id bigint, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=d)]) for i in range(q)], "query_id bigint, embedding array<double>")
    return queries, corpus


def brute_force(queries, corpus, k):
    q = {r.query_id: np.array(r.embedding) for r in queries.collect()}
    c = [(r.vec_id, np.array(r.embedding)) for r in corpus.collect()]
    out = set()
    for i, x in q.items():
        s = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for j, y in c)[:k]
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(s)}
    return out


def triples(df):
    return {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}


def test_broadcast_and_grid_search_agree_with_brute_force(spark, monkeypatch):
    queries, corpus = vector_frames(spark)
    want = brute_force(queries, corpus, 7)
    assert triples(vectors.top_k(queries, corpus, 7)) == want
    assert triples(vectors.top_k(queries, corpus, 7, query_bytes=700)) == want


def test_hot_cells_are_split_without_losing_rows(spark):
    queries, corpus = vector_frames(spark)
    hot = corpus.withColumn("cell", F.lit(0))
    got = vectors.top_k_in_cells(queries.withColumn("cell", F.lit(0)), hot, "cell", 5, cell_bytes=40 * 16 * 8)
    assert triples(got) == brute_force(queries, corpus, 5)


def test_probing_all_cells_is_exact_and_some_cells_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding").limit(30)
    cells = vectors.train_cells(e, 6)
    exact = triples(vectors.top_k(q, e, 10))
    assert triples(vectors.probe_top_k(q, e, cells, 10, n_probe=6)) == exact
    found = [{x[:2] for x in triples(vectors.probe_top_k(q, e, cells, 10, n_probe=n))} & {x[:2] for x in exact} for n in (3, 5)]
    # the vectors are spread evenly, the hardest case for cells: half of them must find most, five of six nearly all
    assert len(exact) * 0.7 <= len(found[0]) <= len(found[1]) and len(found[1]) >= len(exact) * 0.9


def test_embed_once_calls_the_model_per_distinct_text(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(30)], "doc_id int, text string")
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    rows = vectors.embed_once(df, model).collect()
    assert len(rows) == 30 and calls.value == 11


def test_model_hook_retries_and_gives_null(spark):
    df = spark.createDataFrame([("a",), ("bad",)], "prompt string").repartition(1)

    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = {r.prompt: r.response for r in hooks.ask(df, model, batch=1, tries=2, wait=0.0).collect()}
    assert rows == {"a": "A", "bad": None}


def mentions(spark):
    rows = [
        ("PCE", "Metric", "short", "p1", "unit", "%", 0.8), ("power conversion efficiency", "Metric", "a longer text", "p2", "unit", "percent", 0.9),
        ("Power-Conversion Efficiency", "Metric", "short", "p1", "unit", "%", 0.7), ("PCE", "Concept", "", "p3", "unit", "%", 0.6),
    ]
    return spark.createDataFrame(rows, "name string, type string, description string, paper string, prop_key string, prop_value string, confidence double")


def test_entities_merge_by_name_and_type_and_merging_again_changes_nothing(spark):
    m = mentions(spark)
    once = kg_build.merge_entities(m)
    rows = {r.type: r for r in once.collect()}
    assert (rows["Metric"].name, rows["Metric"].description, rows["Metric"].confidence, rows["Metric"].mentions, rows["Metric"].papers) == (
        "Power Conversion Efficiency", "a longer text", 0.9, 3, 2,
    )
    again = kg_build.merge_entities(once.withColumn("paper", F.lit("x")))
    cols = ["entity_id", "type", "name", "description", "confidence"]
    assert sorted(map(tuple, again.select(*cols).collect())) == sorted(map(tuple, once.select(*cols).collect()))
    props = kg_build.entity_properties(m).filter("values > 1").collect()
    assert {r.prop_value for r in props} == {"%", "percent"}


def test_reconcile_rewrites_both_ends(spark):
    vs = spark.createDataFrame([("n1", "a", "X"), ("n2", "b", "X")], "id string, name string, type string")
    es = spark.createDataFrame([("n1", "n2", "USES"), ("n2", "n1", "USES")], "source_id string, target_id string, type string")
    old = spark.createDataFrame([("s1", "a")], "id string, name string")
    keep, edges, remap = kg_build.reconcile(vs, es, old)
    assert [r.id for r in keep.collect()] == ["n2"]
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {("s1", "n2"), ("n2", "s1")}
    assert [(r.old_id, r.stored_id) for r in remap.collect()] == [("n1", "s1")]


def test_containing_finds_what_a_full_comparison_finds(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcA ") for _ in range(r.randint(1, 9))) for _ in range(60)]
    parts = ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(40)]
    got = kg_query.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    assert {(x.t, x.p) for x in got.collect()} == {(t, p) for t in texts for p in parts if p in t.lower()}
    assert got.count() == got.distinct().count()


def test_shortest_paths_match_breadth_first_search(spark):
    r = random.Random(9)
    edges = sorted({tuple(r.sample([f"v{i}" for i in range(14)], 2)) for _ in range(18)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def all_paths(a, b, longest):
        layer = [[a]]
        for _ in range(longest + 1):
            hits = [p for p in layer if p[-1] == b]
            if hits:
                return min(hits)
            layer = [p + [n] for p in layer for n in near.get(p[-1], ()) if n not in p]
        return None

    pairs = [(f"v{i}", f"v{j}") for i in range(0, 14, 2) for j in range(1, 14, 3)]
    want = {(a, b): all_paths(a, b, 4) for a, b in pairs}
    df = spark.createDataFrame([(a, b, "E") for a, b in edges], "source_id string, target_id string, type string")
    for hub in (2, 1000):
        got = kg_query.shortest_paths(spark.createDataFrame(pairs, "source_id string, target_id string"), df, 4, hub)
        assert {(x.source_id, x.target_id): (x.length, x.path) for x in got.collect()} == {k: (len(p) - 1, p) for k, p in want.items() if p}


def test_shortest_paths_through_a_hub_and_out_of_reach(spark):
    n = 900
    edges = [(f"v{i:03}", f"v{i + 1:03}", "E") for i in range(n - 1) if i != 600] + [("v450", f"v{i:03}", "E") for i in range(0, n, 3) if i < 600]
    df = spark.createDataFrame([*edges, ("v001", "v001", "loop"), *edges[:5]], "source_id string, target_id string, type string")
    pairs = [("v000", "v300"), ("v001", "v301"), ("v000", "v700"), ("v602", "v605"), ("v007", "v007"), ("nowhere", "v001"), ("nowhere", "nowhere"), (None, "v001"), ("v000", "v300")]
    got = kg_query.shortest_paths(spark.createDataFrame(pairs, "source_id string, target_id string"), df, 5, 50)
    assert {(x.source_id, x.target_id): x.path for x in got.collect()} == {
        ("v000", "v300"): ["v000", "v450", "v300"], ("v001", "v301"): ["v001", "v000", "v450", "v300", "v301"],
        ("v602", "v605"): ["v602", "v603", "v604", "v605"], ("v007", "v007"): ["v007"], ("nowhere", "nowhere"): ["nowhere"],
    }
    assert kg_query.shortest_paths(spark.createDataFrame([], "source_id string, target_id string"), df).count() == 0


def test_steps_delete_what_is_no_longer_read(spark):
    steps = Steps(spark)
    first = steps.cut(spark.range(3))
    path = steps.paths[0]
    assert os.path.isdir(path)
    kept = steps.keep(first.selectExpr("id + 1 AS id"))
    assert not os.path.isdir(path) and sorted(r["id"] for r in kept.collect()) == [1, 2, 3]


def greedy(rows):
    seen, kept = set(), []
    for row, ids in rows:
        if ids and not seen & set(ids):
            kept.append(row)
            seen |= set(ids)
    return kept


def test_shared_identifiers_follow_the_sequential_rule(spark):
    r = random.Random(11)
    rows = [(g, i, [f"id{r.randint(0, 25)}" for _ in range(r.randint(0, 3))]) for g in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, n int, ids array<string>")
    got = fusion.drop_shared_identifiers(df, "n", "ids", ["query_id"], ["n"]).collect()
    want = {(g, n) for g in ("a", "b") for n in greedy([(i, ids) for h, i, ids in rows if h == g])}
    assert {(x.query_id, x.n) for x in got} == want


def test_chains_of_shared_identifiers_take_a_bounded_number_of_rounds(spark, monkeypatch):
    n = 1000
    rows = [("a", i, [f"c{i}", f"c{i + 1}"]) for i in range(n)] + [("b", i, ["hub"] if i % 3 else [f"c{i}", f"c{i + 2}", "hub"]) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, n int, ids array<string>")
    calls = []
    one = fusion._round
    monkeypatch.setattr(fusion, "_round", lambda *a: calls.append(1) or one(*a))
    got = {(x.query_id, x.n) for x in fusion.drop_shared_identifiers(df, "n", "ids", ["query_id"], ["n"]).collect()}
    assert got == {(g, i) for g in ("a", "b") for i in greedy([(i, ids) for h, i, ids in rows if h == g])} and len(calls) <= 3
    small = df.filter("n < 14")
    want = {(g, i) for g in ("a", "b") for i in greedy([(i, ids) for h, i, ids in rows if h == g and i < 14])}
    assert {(x.query_id, x.n) for x in fusion.drop_shared_identifiers(small, "n", "ids", ["query_id"], ["n"], rounds=2, most_rows=5).collect()} == want


def test_connected_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 60] + [(1000 + r.randint(0, 40), 1000 + r.randint(0, 40)) for _ in range(25)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected(spark.createDataFrame([], "x long, y long")).count() == 0


def test_unscored_contexts_are_dropped_or_kept(spark):
    df = spark.createDataFrame([(1, 0.5, None), (2, None, None), (3, None, 0.1), (4, 0.27, None)], "doc_id int, similarity double, rerank_score double")
    assert {r.doc_id for r in fusion.relevant(df).collect()} == {1}
    assert {r.doc_id for r in fusion.relevant(df, unscored="keep").collect()} == {1, 2}


def test_budget_stops_at_the_first_overflow(spark):
    rows = [(1, i, "s", 0.5, None, "x" * n) for i, n in enumerate([10, 100, 10], 1)]
    df = spark.createDataFrame(rows, "query_id int, rank int, source string, similarity double, rerank_score double, content string")
    r = fusion.budgeted_text(df, max_chars=120).first()
    assert (r.used, r.left_out) == (1, 2) and "[Context 3]" not in r.context_text and r.context_text.startswith("[Context 1] (Source: s, Score: 0.50)\nxxxxxxxxxx\n")


def test_rounds_stop_when_the_evidence_is_good_enough(spark):
    q = spark.createDataFrame([(1, "What is A?"), (2, "How does B affect C?")], "query_id bigint, question string")

    def retrieve(unfinished, round_no):
        return unfinished.select(
            "query_id", (F.lit(round_no) * 10 + F.col("query_id")).alias("doc_id"), F.lit("some text because of reasons").alias("content"), F.lit("vector").alias("source"),
            F.lit(0.8).alias("similarity"), F.lit(None).cast("double").alias("rerank_score"),
        )

    def judge(unfinished, contexts, round_no):
        return unfinished.select("query_id", F.when((F.col("query_id") == 1) | (F.lit(round_no) > 1), "1.0").otherwise("0.1").alias("judge_answer"))

    contexts, history = loop.retrieve_in_rounds(q, retrieve, judge)
    rows = {(r.query_id, r.round): (r.stop, r.n_contexts) for r in history.collect()}
    assert rows == {(1, 1): ("quality_sufficient", 1), (2, 1): (None, 1), (2, 2): ("quality_sufficient", 2)}
    assert contexts.count() == 3
    summary = {r.rounds: r.questions for r in loop.run_summary(history).collect()}
    assert summary == {1: 1, 2: 1}


GOLDEN = [
    ("Model A", "direct_llm", "Device engineering", "easy", "single-hop", 0.2, "q1"), ("Model A", "direct_llm", "Material design", "hard", "multi-hop", 0.4, "q2"),
    ("Model B", "direct_llm", "Device engineering", "easy", "single-hop", 0.3, "q3"), ("Model B", "direct_llm", "Material design", "hard", "multi-hop", 0.6, "q4"),
]


def test_breakdown_golden_records(spark):
    df = spark.createDataFrame(GOLDEN, "model string, mode string, category string, difficulty string, reasoning string, answer_correctness double, question_id string")
    rows = evalcompare.breakdown(df, ("category",)).orderBy("series_order", "group_order").collect()
    assert len(rows) == 4
    assert (rows[0].series_label, rows[0]["group"], rows[0].value) == ("Model B (direct)", "Material design", 0.6)
    assert [r["group"] for r in rows[:2]] == ["Material design", "Device engineering"]


def test_retry_merge_and_missing_metrics(spark):
    cols = "model string, mode string, question_id int, " + ", ".join(f"{m} double" for m in evalscores.v.METRICS)
    old = spark.createDataFrame([("m", "d", 1, 0.1, None, None, None, 0.5, 0.6)], cols)
    new = spark.createDataFrame([("m", "d", 1, None, 0.9, None, None, 0.4, None)], cols)
    r = evalscores.merge_retry(old, new).first()
    assert [r[m] for m in evalscores.v.METRICS] == [0.1, 0.9, None, None, 0.4, 0.6]
    assert old.filter(evalscores.needs_retry()).count() == 1


def test_outliers_and_quartiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 100]] + [("a", None)], "k string, x double")
    r = evalcompare.box_stats(df, "x", ["k"]).first()
    assert (r["values"], r.q1, r.median, r.q3, r.outliers) == (6, 1.25, 2.5, 3.75, 1)


def test_numbering_is_consecutive_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = [r.n for r in qaset.number_rows(df, ["k"]).orderBy("k").collect()]
    assert got == list(range(1, 1001))


def test_category_matching_uses_list_order(spark):
    df = spark.createDataFrame([("stability",), ("Performance Metrics",), ("zzz",)], "c string")
    got = [r[0] for r in df.select(qaset.match_category(F.col("c"))).collect()]
    assert got == ["Stability & Degradation", "Performance Metrics", None]


def test_index_stream_takes_only_new_files(spark):
    source, target = new_path(spark, "in"), new_path(spark, "out")
    docs = spark.createDataFrame([(1, "first document"), (2, "second document")], "doc_id int, text string")
    docs.write.parquet(source)
    assert jobs.index_corpus(jobs.stream_table(spark, source, docs.schema), target).count() == 2
    spark.createDataFrame([(3, "third document")], "doc_id int, text string").write.mode("append").parquet(source)
    rows = jobs.index_corpus(jobs.stream_table(spark, source, docs.schema), target).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3]


def test_identifiers_are_stable_literals(spark):
    r = spark.range(1).select(nm.edge_id(F.lit("a"), F.lit("b"), F.lit("USES"), F.lit("s")).alias("e")).first()
    assert r.e == "USES_" + __import__("hashlib").md5(b"a|b|USES|s").hexdigest()[:12]


def test_a_failing_row_is_named_and_the_others_are_answered(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return ['{"entities": []}' for _ in prompts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(20)], "passage_id long, prompt string").coalesce(1)
    rows = hooks.ask(df, model, tries=1, wait=0.0).collect()
    assert [r["passage_id"] for r in rows if r["response"] is None] == [5]
    assert [r["response_error"] for r in rows if r["response_error"]] == ["RuntimeError: no answer"]
    parsed = kg_build.parse_responses(hooks.ask(df, model, tries=1, wait=0.0))
    entities = kg_build.valid_entities(parsed)
    stats = kg_build.extraction_stats(parsed, entities, kg_build.valid_relations(parsed, entities)).first()
    assert (stats["responses"], stats["failed_calls"], stats["extraction_failures"]) == (20, 1, 0)


def test_rerank_hook(spark):
    df = spark.createDataFrame([("q", "a b"), ("q", "a")], "query string, content string")
    rows = hooks.rerank(df, lambda pairs: [float(len(c)) for _, c in pairs]).collect()
    assert sorted(r["rerank_score"] for r in rows) == [1.0, 3.0]


def test_embed_once_keeps_null_texts_and_names_failures(spark):
    def model(texts):
        return [[1.0 / (len(t) - 3)] for t in texts]

    df = spark.createDataFrame([(1, None), (2, "ab"), (3, "abc"), (4, "ab")], "id long, text string")
    rows = {r["id"]: r for r in vectors.embed_once(df, model).collect()}
    assert len(rows) == 4 and rows[1]["embedding"] is None and rows[3]["embedding"] is None
    assert "ZeroDivisionError" in rows[3]["embedding_error"] and rows[2]["embedding"] == rows[4]["embedding"] == [-1.0]


def test_top_k_without_queries_and_with_odd_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.1]), (8, None)], "query_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.top_k(queries, corpus, 5).orderBy("rank").collect()] == [(7, 1, 1), (7, 5, 2)]
    assert vectors.top_k(queries.filter("query_id = 8"), corpus, 5).count() == 0


def test_one_odd_query_or_vector_takes_nothing_from_the_others(spark):
    queries, corpus = vector_frames(spark)
    want = brute_force(queries, corpus, 7)
    odd_q = spark.createDataFrame([(900, [1.0] * 40), (901, [1.0, 2.0]), (902, None)], "query_id bigint, embedding array<double>")
    odd_c = spark.createDataFrame([(900, [1.0, 2.0]), (901, [1.0] * 5), (902, []), (903, None)], "vec_id bigint, embedding array<double>")
    q, c = queries.unionByName(odd_q), corpus.unionByName(odd_c)
    for size in (64 << 20, 700):
        assert triples(vectors.top_k(q, c, 7, query_bytes=size)) == want | {(901, 900, 1)}
    cells = vectors.top_k_in_cells(q.withColumn("cell", F.lit(0)), c.withColumn("cell", F.lit(0)), "cell", 7)
    assert triples(cells) == want | {(901, 900, 1)}
    left = {(r["side"], r["dims"], r["rows"], r["reason"]) for r in vectors.unmatched(q, c).collect()}
    assert left == {("queries", 40, 1, "length"), ("queries", None, 1, "null"), ("corpus", 5, 1, "length"), ("corpus", 0, 1, "empty"), ("corpus", None, 1, "null")}


def test_braces_are_halved_outside_strings_only(spark):
    cases = {
        '{{"a": "x {{y}}", "b": {{"c": 1}}}}': '{"a": "x {{y}}", "b": {"c": 1}}',
        '{"a": {"b": 1}}': '{"a": {"b": 1}}',
        '{"a": "{{"}': '{"a": "{{"}',
        '{{"a": "q\\"{{"}}': '{"a": "q\\"{{"}',
        '{{"a": "' + "x" * 50_000 + '"}}': '{"a": "' + "x" * 50_000 + '"}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(kg_build.single_braces(F.col("t"))).collect()] == list(cases.values())


def test_metadata_sees_an_edit_of_equal_length_and_a_changed_setting(spark):
    from paperloom.operators.chunking import passages

    def built(text, **config):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return vectors.build_metadata(docs, passages(docs), config=config).first()

    a, b, c = built("one text", size=1), built("two text", size=1), built("one text", size=2)
    assert a["fingerprint"] != b["fingerprint"] and a["fingerprint"] == c["fingerprint"]
    assert a["config_fingerprint"] == b["config_fingerprint"] != c["config_fingerprint"]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=700).round(1), "b": np.array([5.0]), "c": np.array([1.0] * 300 + [2.0]), "d": rng.integers(0, 3, 50).astype(float)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs]
    hist = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    shares = (0.0, 0.25, 0.5, 0.9, 1.0)
    for bins in (4, 256):
        got = {r["g"]: r["quantiles"] for r in evalcompare.exact_quantiles(hist, ["g"], shares, bins).collect()}
        assert all(np.allclose(got[g], np.quantile(xs, shares)) for g, xs in groups.items())


def test_stored_index_appends_prunes_and_finds_most_neighbours(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    points = centers[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.35
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(5000, None), (5001, [])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = corpus.filter("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    path = new_path(spark, "index")
    cells = vectors.train_cells(corpus.filter("vec_id < 600"), 12)
    cellindex.build(corpus.filter("vec_id < 600"), cells, path)
    cellindex.append(corpus.filter("vec_id >= 500"), path)
    assert sorted(r["vec_id"] for r in cellindex.stored(spark, path).collect()) == list(range(900))
    sizes = {r["cell"]: r["vectors"] for r in cellindex.cell_sizes(spark, path).collect()}
    assert len(sizes) == 12 and sum(sizes.values()) == 900
    exact = {(r["query_id"], r["vec_id"]) for r in vectors.top_k(queries, corpus, 10).collect()}
    for budget in (vectors.QUERY_BYTES, 16 * 8 * 5):
        found = {(r["query_id"], r["vec_id"]) for r in cellindex.search(queries, path, 10, n_probe=4, budget=budget).collect()}
        assert len(found & exact) / len(exact) >= 0.9
    all_cells = {(r["query_id"], r["vec_id"]) for r in cellindex.search(queries, path, 10, n_probe=12).collect()}
    assert all_cells == exact
    plan = cellindex.pruned(spark, path, [3, 4])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(3,4\)", plan)


def test_devices_of_records_are_not_shuffled_and_order_is_exact(spark):
    """Ids with a common beginning, a device of two records (its names differ in case) and conflicting properties."""
    rows = [(f"record-{i:05d}", f"10.1/{i % 3}", f"donor {i % 4}", f"acceptor {i % 2}", "x" if i % 5 == 0 else None, f"S{(i * 7) % 11}" if i > 20 else "", f"T{i}", float(i)) for i in range(600)]
    rows += [("RECORD-00007", "10.1/1", "donor 3", "acceptor 1", None, "S0", "T0", 5000.0)]
    schema = "record_id string, doi string, donor_name string, acceptor_name string, additive_id string, donor_smiles string, donor_type string, spin_speed_rpm double"
    records = spark.createDataFrame(rows, schema).repartition(4)
    ids = spark.createDataFrame(kg_build.record_ids(records).collect(), kg_build.record_ids(records).schema)

    def shuffled(df):
        store = spark.sparkContext._jsc.sc().statusStore()

        def total():
            found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
            return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))

        before = total()
        got = df().collect()
        return got, total() - before

    got, moved = shuffled(lambda: kg_build.record_properties(ids))
    found = {(r["id"], r["key"]): r["value"] for r in got}
    assert len(found) == len(got)
    seen = {r["donor_name"]: r["donor_id"] for r in ids.collect()}
    first = sorted(rows)
    for name, vertex in seen.items():
        assert found[vertex, "smiles"] == next(r[5] for r in first if r[2] == name and r[5])
        assert found[vertex, "material_type"] == next(r[6] for r in first if r[2] == name)
    twice = {r["record_id"]: r["device_id"] for r in ids.collect()}
    assert twice["RECORD-00007"] == twice["record-00007"]
    assert found[twice["record-00007"], "record_id"] == "RECORD-00007"
    assert moved < 8 * len(rows), moved

    vertices = {(r["id"], r["type"]): r for r in kg_build.record_vertices(ids).collect()}
    assert vertices[twice["record-00007"], "Device"]["mentions"] == 2
    assert "RECORD-00007" in vertices[twice["record-00007"], "Device"]["description"]
    for name, vertex in seen.items():
        v = vertices[vertex, "Material"]
        assert (v["smiles"], v["mentions"]) == (next(r[5] for r in first if r[2] == name and r[5]), sum(r[2] == name for r in rows))


def test_answers_are_parsed_and_models_asked_once(spark, sf, monkeypatch):
    from paperloom.plans import graph_build_queries as g
    from paperloom.plans import load_all

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    resolved, plain = [], kg_build.named_ids
    monkeypatch.setattr(kg_build, "named_ids", lambda names: resolved.append(1) or plain(names))
    graph = g._built(spark, sf)
    assert len(resolved) == 1
    assert all("from_json" not in plan(df) and "from_json" not in plan(g._parsed(spark, sf)) for df in graph)
    assert "MapInPandas" not in plan(load_all()["f23_graph_from_documents"].plan(spark, sf))


def test_pairs_at_a_hub_are_met_from_their_smaller_side(spark):
    steps = Steps(spark)
    pairs = spark.createDataFrame([("H", f"p{i}") for i in range(50)] + [(f"s{i}", "T") for i in range(50)], "source_id string, target_id string")
    a = spark.createDataFrame([("H", f"x{i}", i) for i in range(40)] + [(f"s{i}", f"y{i}", 0) for i in range(50)], "source_id string, vertex string, above bigint")
    b = spark.createDataFrame([(f"p{i}", f"x{i % 45}") for i in range(50)] + [("T", f"y{i}") for i in range(30)], "target_id string, vertex string")
    by_a, by_b = kg_query._probes(steps, pairs, a, b)
    assert by_a.count() == 50 and by_b.count() == 50
    met = by_a.join(b, ["target_id", "vertex"]).unionByName(by_b.join(a, ["source_id", "vertex"]))
    want = pairs.join(a, "source_id").join(b, ["target_id", "vertex"])
    rows = ["source_id", "target_id", "vertex", "above"]
    assert sorted(map(tuple, met.select(*rows).collect())) == sorted(map(tuple, want.select(*rows).collect())) != []


def test_sequential_rule_is_linear_in_rows():
    import time

    import pandas as pd

    n = 20_000
    rows = [(None if i % 2 else 1.0, i, (i,), f"k{i + j}") for i in range(n) for j in (0, 1)]
    pdf = pd.DataFrame(rows, columns=["g", "r", "_o", "_id"])
    start = time.time()
    kept = fusion._kept_in_order(pdf.sample(frac=1, random_state=1), ["g", "r"], 1)
    # the ids of neighbours belong to different groups here, so all stay
    assert kept["r"].tolist() == list(range(n)) and time.time() - start < 3
    same = fusion._kept_in_order(pdf.assign(g=1.0), ["g", "r"], 1)
    assert same["r"].tolist() == list(range(0, n, 2))


def _device_rows(spark):
    schema = "record_id string, doi string, donor_name string, acceptor_name string, additive_id string, donor_conc double, additive_vol_pct double, mechanism string, pce_percent double, jsc_ma_cm2 double, voc_v double, ff double"
    rows = [
        ("r1", "10.1/1", "A", "B", "x", 2.0, 1.5, "", 10.0, None, 1.0, None), ("r2", None, "A", None, None, None, None, "packing", None, None, None, 0.5),
        (None, "10.1/1", "C", "B", "x", 1.0, 2.5, "finer", 11.0, 3.0, None, None),
    ]
    return kg_build.record_ids(spark.createDataFrame(rows, schema))


def test_an_edge_id_is_computed_once_and_not_per_property(spark):
    ids = _device_rows(spark)
    made = kg_build.record_edge_properties(ids)
    found = {(r["id"], r["key"]): r["value"] for r in made.collect()}
    assert len(found) == made.count()
    edges = {r["id"] for r in kg_build.record_edges(ids).collect()} - {None}
    assert {i for i, _ in found} <= edges and all(found.values())
    assert sorted(v for (i, k), v in found.items() if k == "value") == ["0.5", "1.0", "10.0"]
    assert [v for (i, k), v in found.items() if k == "mechanism"] == [] and [v for (i, k), v in found.items() if k == "vol_pct"] == ["1.5"]
    one = spark.createDataFrame(ids.collect(), ids.schema)
    plan = kg_build.record_edge_properties(one)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 9, plan.count("md5(")


def test_edges_of_records_become_rows_without_structs(spark):
    ids = _device_rows(spark)
    rows = kg_build.record_edges(ids).collect()
    device = {r["record_id"]: r["device_id"] for r in ids.collect()}
    assert sorted(r["type"] for r in rows if r["source_id"] == device["r1"] or r["target_id"] == device["r1"]) == ["CONTAINS", "ENHANCES", "HAS_PROPERTY", "HAS_PROPERTY", "USES", "USES", "USES"]
    assert sorted((r["type"], r["value"]) for r in rows if r["source_id"] == device["r2"] or r["target_id"] == device["r2"]) == [("HAS_PROPERTY", 0.5), ("USES", None)]
    assert sum(r["id"] is None for r in rows) == sum(r["source_id"] == device[None] or r["target_id"] == device[None] for r in rows) > 0
    plan = kg_build.record_edges(ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan, plan


def test_canonical_names_agree_with_the_rule_for_every_kind_of_name(spark):
    names = ["records-ab12-R1", " Spin  Coating ", "a--b", "-a-", "a_b", "__", "", "ä-Öl", "a.b:c/d e", "A\n", "a b", "$V_{oc}$", "x^2", "x²-y", "a-b\n", "İx", "𝒜-b", None]
    key = F.regexp_replace(F.lower(nm.normalize_name(F.col("n"))), r"[^\p{L}\p{N}_]", "_")
    rule = F.btrim(F.regexp_replace(key, "_+", "_"), F.lit("_"))
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", nm.canonical_name(F.col("n")).alias("a"), rule.alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_relations_merge_without_expanding_rows_for_distinct_counts(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice(["T", None]), r.choice("xy"), r.choice(["p1", "p2", None]), r.choice(["", "long", "short", None]), r.choice([0.1, 0.9, None])) for _ in range(60)]
    rows.append(("lone", "T", "x", None, None, None))
    df = spark.createDataFrame(rows, "source_id string, type string, target_id string, paper string, description string, confidence double")
    got = kg_build.merge_relations(df)
    want = {}
    for row in rows:
        want.setdefault(row[:3], []).append(row[3:])
    for x in got.collect():
        of = want.pop((x.source_id, x.type, x.target_id))
        texts = {d for _, d, _ in of if d is not None}
        assert (x.mentions, x.papers, x.descriptions) == (len(of), len({p for p, _, _ in of} - {None}), len(texts - {""}))
        assert x.description == min(texts, default=None) and x.confidence == max((c for _, _, c in of if c is not None), default=None)
    assert not want
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_entities_merge_without_pairing_papers_with_texts(spark):
    n = 30
    rows = [("PCE", "Metric", f"text {i:02d}" + "x" * (i % 7), f"p{j}", (i + j) / 100) for i in range(n) for j in range(n)]
    # no description, no paper, other spellings and a second type
    rows += [("PCE", "Metric", None, "p1", 0.1), ("power-conversion efficiency", "Metric", "text", None, 0.99), ("pce", "Concept", None, None, None)]
    m = spark.createDataFrame(rows, "name string, type string, description string, paper string, confidence double")
    keyed = kg_build.keyed_entities(m)
    # papers and one without, texts and one missing; a row of mentions without paper and a row of texts of the other type
    assert kg_build.entity_statements(keyed).count() == (n + 1) + (n + 2) + 2
    assert kg_build.keyed_entity_parts(keyed).count() == (n + 1) + 1
    out = kg_build.merge_entities(m)
    got = {r.type: (r.mentions, r.papers, r.description, r.confidence) for r in out.collect()}
    assert got == {"Metric": (n * n + 2, n, "text 06xxxxxx", 0.99), "Concept": (1, 0, None, None)}
    twice = kg_build.entities_of_parts(kg_build.merge_entity_parts(kg_build.keyed_entity_parts(keyed).unionByName(kg_build.keyed_entity_parts(keyed))))
    assert {r.type: (r.mentions, r.papers, r.description, r.confidence) for r in twice.collect()} == {k: (2 * v[0], *v[1:]) for k, v in got.items()}


def test_entities_take_the_earliest_name_of_an_order(spark):
    m = spark.createDataFrame([("ab-c", "X", "d", "p2", "2"), ("ab c", "X", "d", "p1", "3"), ("ab_c", "X", None, "p1", "1"), ("ab.c", "X", "e", None, "4")], "name string, type string, description string, paper string, seq string")
    m = m.withColumn("confidence", F.lit(0.5))
    assert [(r.name, r.mentions, r.papers, r.description) for r in kg_build.merge_entities(m).collect()] == [("ab c", 4, 2, "d")]
    plain = m.filter("name <> 'ab c'")
    assert [(r.name, r.mentions) for r in kg_build.merge_entities(plain, "seq").collect()] == [("ab_c", 3)]
    assert [r.name for r in kg_build.merge_entities(plain).collect()] == ["ab-c"]


def test_distinct_rows_are_dealt_out_by_rows_however_well_they_pack(spark, sf):
    df = spark.range(9000).select((F.col("id") % 8000).alias("a"), F.concat(F.lit("x"), F.col("id") % 4000).alias("b"))
    parts = readers.distinct_rows(df, most=500)
    per_task = [r["count"] for r in parts.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 8000 and len(per_task) == 18 and max(per_task) < 1000
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),), (None,), (None,)], "c double")
    assert readers.distinct_rows(odd, most=1).count() == 3
    assert "REPARTITION_BY_NUM" in inputs.raw_entities(spark, sf)._jdf.queryExecution().executedPlan().toString()
