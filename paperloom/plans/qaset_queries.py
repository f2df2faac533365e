"""Question–answer sets from the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.operators import qaset
from paperloom.plans import inputs
from paperloom.plans.registry import query
from paperloom.plans.sqlkit import s, with_inputs
from paperloom.sources.readers import table


def _match_sql(c: str) -> str:
    arms = " ".join(f"WHEN contains(lower({c}), {s(n.lower())}) OR contains({s(n.lower())}, lower({c})) THEN {s(n)}" for n in v.QA_CATEGORIES)
    return f"CASE WHEN {c} IN ({', '.join(s(n) for n in v.QA_CATEGORIES)}) THEN {c} ELSE CASE {arms} END END"


def _in(c: str, allowed: list[str], default: str) -> str:
    return f"CASE WHEN {c} IN ({', '.join(s(a) for a in allowed)}) THEN {c} ELSE {s(default)} END"


_VALID = f"""SELECT paper_id, conv_id, pos, question, answer, coalesce({_match_sql('category')}, {s(v.QA_CATEGORIES[0])}) AS category, {_in('difficulty', v.DIFFICULTIES, 'medium')} AS difficulty,
    {_in('reasoning_type', v.REASONING_TYPES, 'single-hop')} AS reasoning_type FROM qa_pairs WHERE question <> '' AND answer <> ''"""


def _valid(spark, sf):
    return qaset.valid_pairs(inputs.qa_pairs(spark, sf))


@query(
    "n1_valid_points",
    with_inputs(f"SELECT paper_id, pos, {_match_sql('category')} AS category, {_in('reasoning_type', v.REASONING_TYPES, 'single-hop')} AS complexity FROM qa_pairs WHERE answer <> '' AND category <> '' AND {_match_sql('category')} IS NOT NULL"),
)
def _(spark, sf):
    p = inputs.qa_pairs(spark, sf).select("paper_id", "pos", "category", F.col("answer").alias("content"), F.col("reasoning_type").alias("complexity"))
    return qaset.valid_points(p).select("paper_id", "pos", "category", "complexity")


@query("n2_valid_pairs", with_inputs("SELECT paper_id, pos, category, difficulty, reasoning_type FROM validpairs", validpairs=_VALID))
def _(spark, sf):
    return _valid(spark, sf).select("paper_id", "pos", "category", "difficulty", "reasoning_type")


@query("n3_cap_per_paper", with_inputs("SELECT paper_id, pos FROM validpairs QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY pos) <= 2", validpairs=_VALID))
def _(spark, sf):
    return qaset.cap_per_paper(_valid(spark, sf), 2).select("paper_id", "pos")


@query(
    "n4_cross_document_sample",
    with_inputs(
        """SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS point_no, 'hard' AS difficulty, 'cross-doc' AS reasoning_type FROM validpairs WHERE paper_id IN
        (SELECT paper_id FROM (SELECT DISTINCT paper_id FROM validpairs) ORDER BY md5('7|' || paper_id), paper_id LIMIT 10) QUALIFY point_no <= 50""", validpairs=_VALID,
    ),
)
def _(spark, sf):
    return qaset.cross_document_sample(_valid(spark, sf), 10, seed=7).select("paper_id", "pos", "point_no", "difficulty", "reasoning_type")


@query(
    "n4_joined_titles",
    with_inputs("SELECT string_agg(paper_id, ' | ' ORDER BY paper_id) AS source_title FROM (SELECT DISTINCT paper_id FROM validpairs ORDER BY md5('7|' || paper_id), paper_id LIMIT 10)".replace("SELECT DISTINCT paper_id FROM validpairs", "SELECT paper_id FROM (SELECT DISTINCT paper_id FROM validpairs)"), validpairs=_VALID),
)
def _(spark, sf):
    return qaset.joined_titles(qaset.cross_document_sample(_valid(spark, sf), 10, seed=7))


@query("n5_export_ids", with_inputs("SELECT paper_id, pos, printf('qa_%04d', row_number() OVER (ORDER BY paper_id, pos)) AS id FROM validpairs", validpairs=_VALID))
def _(spark, sf):
    return qaset.export_ids(_valid(spark, sf), ["paper_id", "pos"]).select("paper_id", "pos", "id")


@query(
    "n6_statistics",
    with_inputs(
        """SELECT CAST(sum(n) AS BIGINT) AS total_qa_pairs, count(*) AS total_papers, round_even(avg(n), 6) AS avg_qa_per_paper, min(n) AS min_qa_per_paper, max(n) AS max_qa_per_paper FROM
        (SELECT count(*) AS n FROM validpairs GROUP BY paper_id)""", validpairs=_VALID,
    ),
)
def _(spark, sf):
    return qaset.statistics(_valid(spark, sf))


@query(
    "n6_distributions",
    with_inputs(
        "SELECT dimension, label, n, round_even(n * 100 / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM ("
        + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS label, count(*) AS n FROM validpairs GROUP BY {d}" for d in ("category", "difficulty", "reasoning_type")) + ")", validpairs=_VALID,
    ),
)
def _(spark, sf):
    return qaset.distributions(_valid(spark, sf))


@query(
    "n7_per_paper",
    with_inputs(
        """SELECT paper_id, CAST(sum(n) AS BIGINT) AS pairs, string_agg(category, ', ' ORDER BY rank) FILTER (WHERE rank <= 2) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, category) AS rank
        FROM (SELECT paper_id, category, count(*) AS n FROM validpairs GROUP BY ALL)) GROUP BY paper_id""", validpairs=_VALID,
    ),
)
def _(spark, sf):
    return qaset.per_paper(_valid(spark, sf))


@query(
    "n7_per_source",
    "SELECT source, CAST(sum(n) AS BIGINT) AS pairs, string_agg(lang, ', ' ORDER BY rank) FILTER (WHERE rank <= 2) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS rank FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) GROUP BY source",
)
def _(spark, sf):
    return qaset.per_paper(table(spark, sf, "documents"), "source", "lang")


def _files(spark, sf):
    """One row per document as if it were a scanned file: some errored, some empty, some unreadable."""
    k = F.col("doc_id") % 7
    item = F.struct(F.col("source").alias("question"))
    return table(spark, sf, "documents").select(
        "doc_id", F.when(k == 0, "{bad").alias("_corrupt_record"), F.struct(F.when(k == 1, "HTTP 500").alias("error")).alias("token_usage"),
        F.when(k == 2, F.array().cast("array<struct<question:string>>")).otherwise(F.array(item, item)).alias("qa_pairs"),
    )


_STATUS = "['unreadable', 'errored', 'empty', 'ok', 'ok', 'ok', 'ok'][1 + doc_id % 7]"


@query("n8_file_status", f"SELECT doc_id, {_STATUS} AS status FROM documents")
def _(spark, sf):
    return qaset.file_status(_files(spark, sf), "qa_pairs").select("doc_id", "status")


@query("n8_missing_categories", with_inputs(f"SELECT c AS category FROM (VALUES {', '.join('(' + s(c) + ')' for c in v.QA_CATEGORIES)}) t(c) WHERE c NOT IN (SELECT category FROM qa_pairs WHERE difficulty = 'extreme')"))
def _(spark, sf):
    return qaset.missing_categories(inputs.qa_pairs(spark, sf).filter("difficulty = 'extreme'"))


@query("n9_status_counts", f"SELECT status, count(*) AS files, CAST(sum(CASE WHEN status = 'ok' THEN 2 ELSE 0 END) AS BIGINT) AS items FROM (SELECT {_STATUS} AS status FROM documents) GROUP BY status")
def _(spark, sf):
    return qaset.status_counts(qaset.file_status(_files(spark, sf), "qa_pairs"), "qa_pairs")


_EXTRACTED = "CASE WHEN conv_id % 10 = 0 THEN NULL WHEN n_null > 0 OR conv_id % 7 = 3 THEN 'error' ELSE 'ok' END"
_GENERATED = "CASE WHEN n_user = 0 OR n_assistant = 0 THEN NULL WHEN conv_id % 5 = 1 THEN 'empty' ELSE 'ok' END"
_EXPORTED = "CASE WHEN n_chars > 400 THEN 'ok' END"
_CONVS = f"""SELECT *, CASE WHEN c = 'ok' THEN 'export' WHEN b = 'ok' THEN 'generate' WHEN a = 'ok' THEN 'extract' ELSE 'waiting' END AS stage FROM
    (SELECT conv_id, {_EXTRACTED} AS a, {_GENERATED} AS b, {_EXPORTED} AS c FROM (SELECT conv_id, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE role = 'user') AS n_user,
    count(*) FILTER (WHERE role = 'assistant') AS n_assistant, coalesce(sum(length(text)), 0) AS n_chars FROM conversations GROUP BY conv_id))"""


def _located(spark, sf):
    """Conversations as items: stage files derived from their turns; some items have files of later stages only."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"),
    )
    files = {n: c.select("conv_id", F.expr(e).alias("status")).filter("status IS NOT NULL") for n, e in (("extract", _EXTRACTED), ("generate", _GENERATED), ("export", _EXPORTED))}
    return qaset.stages(c, files, "conv_id")


@query("n9_stages", f"SELECT conv_id, a AS extract_status, b AS generate_status, c AS export_status, stage FROM ({_CONVS})")
def _(spark, sf):
    return _located(spark, sf)


@query(
    "n9_stage_counts",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS stage, count(*) FILTER (WHERE stage = '{n}') AS items, count(*) FILTER (WHERE {x} = 'ok') AS done, count(*) FILTER (WHERE {x} <> 'ok') AS failed, count(*) FILTER (WHERE {x} IS NULL) AS open
        FROM ({_CONVS})""" for n, x in (("extract", "a"), ("generate", "b"), ("export", "c"))
    ) + f" UNION ALL SELECT 'waiting', count(*) FILTER (WHERE stage = 'waiting'), NULL, NULL, NULL FROM ({_CONVS})",
)
def _(spark, sf):
    return qaset.stage_counts(_located(spark, sf), ["extract", "generate", "export"])


@query("n10_unprocessed", f"SELECT doc_id, source FROM documents WHERE {_STATUS} <> 'ok'")
def _(spark, sf):
    return qaset.unprocessed(table(spark, sf, "documents").select("doc_id", "source"), qaset.file_status(_files(spark, sf), "qa_pairs"), "doc_id")


_USAGE = """SELECT event_type, count(*) AS requests, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens,
    round(sum(p + c) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000), 6) AS tokens_per_minute, round(sum(p) / 1000 * 0.01 + sum(c) / 1000 * 0.03, 6) AS estimated_cost_usd FROM
    (SELECT event_type, ts, user_id + 100 AS p, CAST(json_extract_string(props, '$.k') AS BIGINT) AS c FROM events) GROUP BY event_type"""


@query("n11_token_usage", _USAGE)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "event_type", "ts", (F.col("user_id") + 100).alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("bigint").alias("completion_tokens")
    )
    u = qaset.token_usage(e, ["event_type"])
    return u.withColumns({c: F.round(c, 6) for c in ("tokens_per_minute", "estimated_cost_usd")})
