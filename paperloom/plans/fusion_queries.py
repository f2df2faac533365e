"""Retrieval, fusion and ranking over the contexts of all questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.operators import fusion, gather, hooks, kg_query, listrank
from paperloom.plans import inputs
from paperloom.plans.graph_queries import _FACT_LINES, _FUZZY, _HITS, _PAIRS, _QFACTS, _WORDS, _facts, _graph, _words
from paperloom.plans.question_queries import TYPE_SQL
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import contains_any, s, strip, with_inputs
from paperloom.plans.text_queries import _closed_sql
from paperloom.sources.readers import spread, table

CTX = "query_id, doc_id, rank, similarity, rerank_score, source, section_type, has_numerical_data"


def _cols():
    return CTX.split(", ")


def _questions(spark, sf):
    return inputs.questions(spark, sf).withColumnRenamed("item_id", "query_id")


@query("i1_vector_retrieve", with_inputs(f"SELECT {CTX} FROM contexts"))
def _(spark, sf):
    return inputs.contexts(spark, sf).select(*_cols())


_SUMMARY = """SELECT item_id AS query_id, concat_ws('. ', CASE WHEN len(e) > 0 THEN 'Entities: ' || array_to_string(e[1:5], ', ') END,
    CASE WHEN len(r) > 0 THEN 'Relationships: ' || array_to_string(r[1:5], '; ') END) AS summary FROM (SELECT item_id, coalesce(list(text ORDER BY pos, rank) FILTER (WHERE kind = 'entity'), []) AS e,
    coalesce(list(text ORDER BY pos, rank) FILTER (WHERE kind = 'relation'), []) AS r FROM words JOIN hits USING (keyword) GROUP BY item_id)"""


@query("i2_hybrid_retrieve", with_inputs("SELECT query_id, rank, doc_id, similarity, summary AS graph_facts FROM contexts LEFT JOIN summaries USING (query_id)", words=_WORDS, kwpairs=_PAIRS, hits=_HITS, summaries=_SUMMARY))
def _(spark, sf):
    w = _words(spark, sf)
    facts = kg_query.keyword_summaries(w, kg_query.keyword_hits(w, *_graph(spark, sf)))
    c = inputs.contexts(spark, sf).select("query_id", "rank", "doc_id", "similarity")
    return c.join(facts.select(F.col("item_id").alias("query_id"), F.col("summary").alias("graph_facts")), "query_id", "left")


@query(
    "i2_hybrid_facts",
    with_inputs(
        """SELECT c.query_id, rank, doc_id, similarity, md5(knowledge) AS facts_md5 FROM contexts c LEFT JOIN (SELECT item_id AS query_id, string_agg(fact, chr(10) || chr(10) ORDER BY name, id) AS knowledge
        FROM qfacts JOIN factlines USING (id) GROUP BY item_id) USING (query_id)""", words=_WORDS, fuzzy=_FUZZY, qfacts=_QFACTS, factlines=_FACT_LINES,
    ),
)
def _(spark, sf):
    facts, vs, es = _facts(spark, sf)
    c = inputs.contexts(spark, sf).select("query_id", "rank", "doc_id", "similarity")
    found = kg_query.hybrid_retrieve(c, facts.withColumnRenamed("item_id", "query_id"), vs, es)
    return found.withColumn("facts_md5", F.md5("graph_facts")).drop("graph_facts")


_SCORES = "SELECT item_id AS query_id, i AS index, CAST((item_id * 13 + i * 29) % 97 AS DOUBLE) / 97 AS score FROM benchmark, range(0, 30, 2) t(i)"


def _score_table(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(28), F.lit(2))).alias("index"))
    return q.withColumn("score", ((F.col("query_id") * 13 + F.col("index") * 29) % 97).cast("double") / 97)


@query(
    "i3_apply_rerank",
    with_inputs(
        """SELECT query_id, doc_id, new_rank, round(score, 6) AS rerank_score FROM (SELECT c.query_id, doc_id, score, row_number() OVER (PARTITION BY c.query_id ORDER BY score DESC, rank) AS new_rank
        FROM contexts c JOIN scores s ON s.query_id = c.query_id AND s.index = c.rank - 1) WHERE new_rank <= 8""", scores=_SCORES,
    ),
)
def _(spark, sf):
    done = fusion.apply_rerank(inputs.contexts(spark, sf), _score_table(spark, sf), v.RERANK_TOP_N)
    return done.select("query_id", "doc_id", "new_rank", F.round("rerank_score", 6).alias("rerank_score"))


@query("i4_order_fallback", with_inputs("SELECT query_id, doc_id, round_even(1.0::DOUBLE - (rank - 1) * 0.1::DOUBLE, 6) AS rerank_score FROM contexts"))
def _(spark, sf):
    return fusion.order_fallback(inputs.contexts(spark, sf)).select("query_id", "doc_id", "rerank_score")


@query(
    "i4_parsed_scores",
    with_inputs(
        """SELECT query_id, doc_id, round(CASE WHEN missing THEN CASE WHEN rank <= 10 THEN 0.6::DOUBLE - (rank - 1) * 0.05::DOUBLE ELSE 0.4::DOUBLE END WHEN top > 1 THEN raw / top ELSE raw END, 6) AS rerank_score
        FROM (SELECT *, max(raw) OVER (PARTITION BY query_id) AS top, count(*) FILTER (WHERE raw IS NULL) OVER (PARTITION BY query_id) > 0 AS missing FROM (SELECT *, CASE WHEN query_id % 3 = 0 THEN rerank_score
        ELSE ((doc_id * 7 + query_id) % 50)::DOUBLE / CASE WHEN query_id % 3 = 1 THEN 5 ELSE 50 END END AS raw FROM contexts))"""
    ),
)
def _(spark, sf):
    q = F.col("query_id")
    other = ((F.col("doc_id") * 7 + q) % 50).cast("double") / F.when(q % 3 == 1, 5).otherwise(50)
    c = inputs.contexts(spark, sf).withColumn("raw_score", F.when(q % 3 == 0, F.col("rerank_score")).otherwise(other))
    return fusion.parsed_rerank_scores(c).select("query_id", "doc_id", "rerank_score")


@query(
    "i5_compare_rankings",
    with_inputs(
        """SELECT query_id, rank, a.doc_id AS by_similarity, a.similarity, b.doc_id AS by_rerank, b.rerank_score, coalesce(a.doc_id = b.doc_id, false) AS same FROM
        (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) AS rank FROM contexts QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, rank) <= 5) a
        FULL JOIN (SELECT query_id, doc_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM contexts WHERE rerank_score IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) <= 5) b USING (query_id, rank)"""
    ),
)
def _(spark, sf):
    return fusion.compare_rankings(inputs.contexts(spark, sf))


@query(
    "i6_rerank_numeric",
    with_inputs(
        f"""SELECT query_id, doc_id, CASE WHEN numeric_q THEN r ELSE rank END AS new_rank FROM (SELECT c.*, numeric_q, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank) AS r
        FROM contexts c JOIN (SELECT item_id AS query_id, {TYPE_SQL} = 'numerical' AS numeric_q FROM questions) USING (query_id)) WHERE NOT numeric_q OR (r <= 5 AND rerank_score IS NOT NULL)"""
    ),
)
def _(spark, sf):
    return fusion.rerank_numeric(inputs.contexts(spark, sf), _questions(spark, sf)).select("query_id", "doc_id", "new_rank")


@query(
    "i7_relevant",
    with_inputs(
        f"""SELECT query_id, doc_id FROM contexts JOIN questions ON item_id = query_id WHERE coalesce(similarity, rerank_score, 0) >=
        CASE WHEN section_type IN ('results', 'performance') OR ({contains_any('question', v.NUMERIC_QUERY_WORDS)} AND has_numerical_data) THEN 0.25 ELSE 0.3 END"""
    ),
)
def _(spark, sf):
    c = inputs.contexts(spark, sf).join(_questions(spark, sf), "query_id")
    return fusion.relevant(c, F.col("question"), F.array(F.lit("results"), F.lit("performance"))).select("query_id", "doc_id")


_KEY = strip("left(content, 200)")


@query("i8_drop_near_copies", with_inputs(f"SELECT query_id, doc_id, rank FROM contexts WHERE {_KEY} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, {_KEY} ORDER BY rank) = 1"))
def _(spark, sf):
    return fusion.drop_near_copies(inputs.contexts(spark, sf), ["query_id"], ["rank"]).select("query_id", "doc_id", "rank")


@query("i8_corpus_near_copies", f"SELECT doc_id, source FROM documents WHERE {strip('text')} <> '' QUALIFY row_number() OVER (PARTITION BY {strip('text')} ORDER BY doc_id) = 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return fusion.drop_near_copies(d, [], ["doc_id"], chars=None).select("doc_id", "source")


_MERGED = """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY web, r) AS final_rank FROM (SELECT *, least(count(*) FILTER (WHERE web) OVER (PARTITION BY query_id), 2) AS slots FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id, web ORDER BY coalesce(rerank_score, similarity, 0) DESC, rank) AS r FROM (SELECT *, starts_with(source, 'web') AS web FROM contexts)))
    WHERE r <= CASE WHEN web THEN slots ELSE 8 - slots END"""


@query("i9_merge_sources", with_inputs("SELECT query_id, doc_id, final_rank FROM merged", merged=_MERGED))
def _(spark, sf):
    return fusion.merge_sources(inputs.contexts(spark, sf), limit=8, web_limit=2).select("query_id", "doc_id", "final_rank")


@query(
    "i10_context_stats",
    with_inputs(
        """SELECT query_id, count(*) AS total_contexts, count(DISTINCT source) AS unique_sources, count(*) FILTER (WHERE similarity IS NOT NULL OR rerank_score IS NOT NULL) AS has_scores,
        count(*) FILTER (WHERE source IN ('vector', 'report.pdf')) AS vector_contexts, count(*) FILTER (WHERE source = 'neo4j') AS kg_contexts, count(*) FILTER (WHERE source LIKE 'web%') AS web_contexts,
        0 AS other_contexts FROM contexts GROUP BY query_id"""
    ),
)
def _(spark, sf):
    return fusion.context_stats(inputs.contexts(spark, sf))


@query(
    "i11_budgeted_text",
    with_inputs(
        f"""SELECT query_id, count(*) FILTER (WHERE fits) AS used, count(*) FILTER (WHERE NOT fits) AS left_out, md5(coalesce(string_agg(entry, chr(10) ORDER BY n) FILTER (WHERE fits), '') ||
        CASE WHEN bool_and(fits) THEN '' ELSE CASE WHEN bool_or(fits) THEN chr(10) ELSE '' END || {s(v.TRUNCATION_NOTE)} END) AS text_md5 FROM (SELECT query_id, n, entry,
        sum(length(entry)) OVER (PARTITION BY query_id ORDER BY n) <= 4000 AS fits FROM (SELECT query_id, rank AS n, concat('[Context ', row_number() OVER (PARTITION BY query_id ORDER BY rank), '] (Source: ', source, ', Score: ',
        printf('%.2f', coalesce(similarity, rerank_score, 0)), ')', chr(10), content, chr(10)) AS entry FROM contexts)) GROUP BY query_id"""
    ),
)
def _(spark, sf):
    t = fusion.budgeted_text(inputs.contexts(spark, sf))
    return t.select("query_id", "used", "left_out", F.md5("context_text").alias("text_md5"))


@query(
    "i12_primary_layout",
    with_inputs(
        f"""SELECT query_id, md5(layout || CASE WHEN coalesce(summary, '') <> '' THEN chr(10) || '=== SUPPLEMENTARY ===' || chr(10) || summary ELSE '' END) AS layout_md5 FROM
        (SELECT query_id, string_agg(b, chr(10) ORDER BY n) AS layout FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n,
        concat('[Document ', row_number() OVER (PARTITION BY query_id ORDER BY rank), '] (Source: ', source, ')', chr(10), {_closed_sql('content')}, chr(10)) AS b FROM contexts QUALIFY n <= 5) GROUP BY query_id)
        LEFT JOIN summaries USING (query_id)""",
        words=_WORDS, kwpairs=_PAIRS, hits=_HITS, summaries=_SUMMARY,
    ),
)
def _(spark, sf):
    w = _words(spark, sf)
    facts = kg_query.keyword_summaries(w, kg_query.keyword_hits(w, *_graph(spark, sf))).select(F.col("item_id").alias("query_id"), F.col("summary").alias("fact"))
    return fusion.primary_layout(inputs.contexts(spark, sf), facts).select("query_id", F.md5("layout").alias("layout_md5"))


@query(
    "i13_citations",
    with_inputs(
        """SELECT query_id, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources, '[Sources: ' || concat_ws(' + ', CASE WHEN a > 0 THEN a || ' vector docs' END, CASE WHEN b > 0 THEN b || ' KG entities' END,
        CASE WHEN c > 0 THEN c || ' web results' END) || ']' AS citation FROM (SELECT query_id, source, count(*) FILTER (WHERE source IN ('vector', 'report.pdf')) OVER (PARTITION BY query_id) AS a,
        count(*) FILTER (WHERE source = 'neo4j') OVER (PARTITION BY query_id) AS b, count(*) FILTER (WHERE source LIKE 'web%') OVER (PARTITION BY query_id) AS c FROM contexts) GROUP BY query_id, a, b, c"""
    ),
)
def _(spark, sf):
    return fusion.citations(inputs.contexts(spark, sf))


PROVIDERS = list(v.PROVIDER_BASE_SCORES)


def _results(spark, sf):
    """Pages as search results: a host is a query, the page number decides provider and identifiers."""
    i = F.col("page_id")
    return table(spark, sf, "pages").select(
        F.regexp_extract("url", r"^https?://(?:[^/]*\.)?([a-z]+\.[a-z]+)(?:/|$|\?|#)", 1).alias("query_id"),
        "page_id", F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("url"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        inputs.choose(i % 5, PROVIDERS).alias("source"),
        F.when(i % 3 == 0, F.concat(F.lit("10.1/"), F.floor(i / 6).cast("string"))).alias("doi"),
        F.when(i % 4 == 0, F.concat(F.lit("a"), F.floor(i / 8).cast("string"))).alias("arxiv"),
    )


_RESULTS = f"""SELECT regexp_extract(url, '^https?://(?:[^/]*\\.)?([a-z]+\\.[a-z]+)(?:/|$|\\?|#)', 1) AS query_id, page_id, split_part(split_part(url, '?', 1), '#', 1) AS url,
    regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CASE page_id % 5 {' '.join(f"WHEN {i} THEN {s(p)}" for i, p in enumerate(PROVIDERS))} END AS source FROM pages"""


@query("i14_shared_identifiers")
def _(spark, sf):
    r = _results(spark, sf)
    ids = F.filter(F.array(F.col("url"), F.concat(F.lit("doi:"), F.col("doi")), F.concat(F.lit("arxiv:"), F.col("arxiv"))), lambda x: x.isNotNull())
    return fusion.drop_shared_identifiers(r.withColumn("ids", ids), "page_id", "ids", ["query_id"], ["page_id"]).select("query_id", "page_id")


@query("i14_chains", "SELECT doc_id // 1000 AS query_id, doc_id FROM documents WHERE doc_id % 1000 % 2 = 0")
def _(spark, sf):
    """Every document shares one identifier with the next of its thousand, so every other one stays."""
    d = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 1000).alias("query_id"), "doc_id")
    ids = F.array(F.concat(F.lit("k"), F.col("doc_id").cast("string")), F.concat(F.lit("k"), (F.col("doc_id") + 1).cast("string")))
    return fusion.drop_shared_identifiers(d.withColumn("ids", ids), "doc_id", "ids", ["query_id"], ["doc_id"]).select("query_id", "doc_id")


@query("i15_repeated_urls", with_inputs("SELECT query_id, page_id, url FROM results WHERE coalesce(nullif(trim(url), ''), title) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY page_id) = 1", results=_RESULTS))
def _(spark, sf):
    return fusion.drop_repeated_urls(_results(spark, sf), ["query_id"], ["page_id"]).select("query_id", "page_id", "url")


@query(
    "i16_allocate",
    with_inputs(
        """SELECT query_id, page_id, source, row_number() OVER (PARTITION BY query_id ORDER BY p, r) AS merged_rank FROM (SELECT *, page_id % 5 AS p, row_number() OVER (PARTITION BY query_id, source ORDER BY page_id) AS r
        FROM results) WHERE r <= 2 QUALIFY merged_rank <= 10""", results=_RESULTS,
    ),
)
def _(spark, sf):
    return fusion.allocate(_results(spark, sf), PROVIDERS, 10, ["page_id"]).select("query_id", "page_id", "source", "merged_rank")


_BASE = "CASE source " + " ".join(f"WHEN {s(k)} THEN {x}::DOUBLE" for k, x in v.PROVIDER_BASE_SCORES.items()) + " ELSE 0.62::DOUBLE END"


@query(
    "i17_provider_scores",
    with_inputs(
        f"""SELECT page_id, round(greatest(0.35, least(0.95, {_BASE} - (page_id % 20) * 0.02::DOUBLE)), 6) AS similarity,
        concat_ws(chr(10), CASE WHEN title <> '' THEN title END, CASE WHEN page_id % 2 = 0 THEN 'Summary: ' || query_id END, 'URL: ' || url) AS content FROM results""", results=_RESULTS,
    ),
)
def _(spark, sf):
    r, i = _results(spark, sf), F.col("page_id")
    none = F.lit(None).cast("string")
    return r.select(
        "page_id", fusion.provider_score(F.col("source"), i % 20).alias("similarity"),
        fusion.result_text(F.col("title"), F.when(i % 2 == 0, F.col("query_id")), none, none, F.col("url")).alias("content"),
    )


@query(
    "i18_with_fallback",
    with_inputs(
        "SELECT query_id, page_id, source FROM (SELECT *, list_position([" + ", ".join(s(p) for p in PROVIDERS) + "], source) AS p FROM results) QUALIFY p = min(p) OVER (PARTITION BY query_id)",
        results=_RESULTS,
    ),
)
def _(spark, sf):
    r = _results(spark, sf).select("query_id", "page_id", "source")
    found = r.filter(F.col("source") == PROVIDERS[0])
    for p in PROVIDERS[1:]:
        found = fusion.with_fallback(found, r.filter(F.col("source") == p), ["query_id"])
    return found


# --- context sources and list rerankers --------------------------------------------------------------------------------
def _web_text(questions: list[str]) -> list[str]:
    """A stand-in provider that times out for some questions."""
    if any(len(q) % 5 == 3 for q in questions):
        raise TimeoutError("no answer")
    return ["page about " + q for q in questions]


def _gathered(spark, sf):
    def near(asked):
        found = inputs.contexts(spark, sf, 3).select("query_id", F.col("content").alias("passage"), "similarity")
        return found.join(asked.select("query_id"), "query_id", "left_semi")

    def web(asked):
        return hooks.ask(asked, _web_text, "question", "content", wait=0.0)

    def out_of_order(asked):
        raise ConnectionError("no route")

    sources = gather.Registry(
        gather.Source("vector", near, columns={"content": "passage"}),
        gather.Source("web", web, needs=F.col("query_id") % 2 == 0, error="content_error"),
        gather.Source("graph", out_of_order, needs=F.col("query_id") % 7 == 0),
    )
    return sources.gather(_questions(spark, sf))


_ASKED = "SELECT item_id AS query_id, question FROM questions"
_NEAR = "SELECT query_id, content, similarity FROM contexts WHERE rank <= 3"


@query(
    "p1_gathered_contexts",
    with_inputs(
        """SELECT query_id, 'vector' AS source, md5(content) AS content_md5, similarity FROM near
        UNION ALL SELECT query_id, 'web', md5('page about ' || question), NULL FROM asked WHERE query_id % 2 = 0 AND length(question) % 5 <> 3""", asked=_ASKED, near=_NEAR,
    ),
)
def _(spark, sf):
    contexts, _ = _gathered(spark, sf)
    return contexts.select("query_id", "source", F.md5("content").alias("content_md5"), "similarity")


@query(
    "p1_source_outcomes",
    with_inputs(
        """SELECT a.query_id, 'vector' AS source, CASE WHEN n > 0 THEN 'found' ELSE 'empty' END AS outcome, coalesce(n, 0) AS results, CAST(NULL AS VARCHAR) AS reason
        FROM asked a LEFT JOIN (SELECT query_id, count(*) AS n FROM near GROUP BY query_id) USING (query_id)
        UNION ALL SELECT query_id, 'web', CASE WHEN length(question) % 5 = 3 THEN 'failed' ELSE 'found' END, CASE WHEN length(question) % 5 = 3 THEN 0 ELSE 1 END,
        CASE WHEN length(question) % 5 = 3 THEN 'TimeoutError: no answer' END FROM asked WHERE query_id % 2 = 0
        UNION ALL SELECT query_id, 'graph', 'failed', 0, 'ConnectionError: no route' FROM asked WHERE query_id % 7 = 0""", asked=_ASKED, near=_NEAR,
    ),
)
def _(spark, sf):
    return _gathered(spark, sf)[1]


def _list_model(question: str, texts: list[str], top_n: int) -> list[tuple[int, float]]:
    """A stand-in reranker: scores by length, with answers out of range, and failures."""
    if len(question) % 7 == 0:
        raise RuntimeError("rate limit")
    found = [(i, len(t) % 97 / 97) for i, t in enumerate(texts)] + [(len(texts) + 3, 9.9), (-1, 5.0)]
    return sorted(found, key=lambda x: (-x[1], x[0]))[: top_n + 2]


_RERANKED = """SELECT c.query_id, doc_id, rank, length(content) % 97 / 97.0::DOUBLE AS score, length(question) % 7 = 0 AS fails,
    row_number() OVER (PARTITION BY c.query_id ORDER BY length(content) % 97 DESC, rank) AS r FROM contexts c JOIN questions ON item_id = c.query_id"""


def _list_ranked(spark, sf):
    return listrank.rerank_lists(inputs.contexts(spark, sf), _questions(spark, sf), _list_model, v.RERANK_TOP_N, block=9, tries=1)


@query(
    "p3_rerank_lists",
    with_inputs(
        """SELECT query_id, doc_id, CASE WHEN fails THEN rank ELSE r END AS new_rank, round_even(CASE WHEN fails THEN 1.0::DOUBLE - (rank - 1) * 0.1::DOUBLE ELSE score END, 6) AS rerank_score
        FROM reranked WHERE fails OR r <= 8""", reranked=_RERANKED,
    ),
)
def _(spark, sf):
    done, _ = _list_ranked(spark, sf)
    return done.select("query_id", "doc_id", "new_rank", F.bround("rerank_score", 6).alias("rerank_score"))


@query(
    "p3_rerank_info",
    with_inputs(
        """SELECT query_id, CASE WHEN fails THEN 'similarity_fallback' ELSE 'reranking' END AS method, count(*) AS original_count, CASE WHEN fails THEN 0 ELSE least(count(*), 8) END AS reranked_count,
        CASE WHEN fails THEN 0 ELSE 2 * CAST(ceil(count(*) / 9) AS BIGINT) END AS ignored, CASE WHEN fails THEN 'RuntimeError: rate limit' END AS reason FROM reranked GROUP BY query_id, fails""", reranked=_RERANKED,
    ),
)
def _(spark, sf):
    return _list_ranked(spark, sf)[1]
