"""Inputs that the registered queries derive from the supplied tables, so that their work grows with the tables.

The supplied texts hold no headings, units or citations; ``papers`` writes some between their lines.  All rules are
functions of ids, and the SQL twins live in ``sqlkit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.operators import vectors
from paperloom.plans.sqlkit import HEADINGS, MEASUREMENTS, MODELS, SECTION_CYCLE, STEMS
from paperloom.session import cut_lineage
from paperloom.sources.readers import distinct_rows, spread, table


def choose(index: Column, options: list, default=None) -> Column:
    """The option with the given number."""
    out = F.lit(default)
    for i, o in reversed(list(enumerate(options))):
        out = F.when(index == i, F.lit(o)).otherwise(out)
    return out


def papers(spark: SparkSession, sf: str) -> DataFrame:
    doc = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))

    def line(x: Column, i: Column) -> Column:
        k = F.col("doc_id") + i
        digit = (F.col("doc_id") % 10).cast("string")
        note = choose(k % 5, MEASUREMENTS, "")
        return F.concat(choose(k % 17, HEADINGS, ""), x, F.replace(note, F.lit("{d}"), digit))

    return doc.withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        "item_id", F.concat(choose(F.col("item_id") % 8, STEMS), F.lit(" "), F.col("text")).alias("question")
    )


def _fan(df: DataFrame, name: str, n: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(n)])))


def _labels(q: Column) -> dict[str, Column]:
    return {
        "category": choose(q % 8, v.QA_CATEGORIES),
        "difficulty": choose(q % 3, v.DIFFICULTIES),
        "reasoning": choose(q % 2, v.REASONING_TYPES),
    }


def _value(j: Column) -> Column:
    q, m, k = F.col("question_id"), F.col("m"), F.col("k")
    raw = ((q * 7 + m * 13 + k * 17 + j * 5 + q * m * 3) % 101).cast("double") / 100
    return F.when((q + m + j) % 11 == 0, None).when((q + j + k) % 13 == 0, 0.0).otherwise(raw)


def eval_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per model, mode and question: answer, error, times and six metric columns."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    df = _fan(_fan(q, "m", 5), "k", 3)
    i, m, k = F.col("question_id"), F.col("m"), F.col("k")
    e = (i + m * 3 + k) % 17
    a = (i + m + k * 5) % 19
    return df.select(
        choose(m, MODELS).alias("model"),
        choose(k, v.MODES).alias("mode"),
        "question_id",
        *[c.alias(n) for n, c in _labels(i).items()],
        F.col("text").alias("question"),
        F.when(a == 0, "").when(a == 1, "Error: no answer").otherwise(F.concat(F.col("text"), F.lit(" [Sources: 2 vector docs]"))).alias("answer"),
        F.when(i % 6 == 0, "").otherwise(F.col("text")).alias("ground_truth"),
        F.when(e == 0, "HTTP 429 Rate Limit").when(e == 1, "Connection timeout").when(e == 2, "bad value").alias("error"),
        ((i * 31 + m * 7 + k) % 300).cast("double").alias("response_time"),
        (1 + (i + m + k) % 3).cast("int").alias("iterations"),
        (((i * 11 + m * 3 + k) % 101).cast("double") / 100).alias("quality_score"),
        ((i + m) % 5).cast("int").alias("n_contexts"),
        *[_value(F.lit(j)).alias(name) for j, name in enumerate(v.METRICS)],
    )


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark questions with the vectors of the same id."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding"))
    return b.join(e, "query_id")


def contexts(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """The k nearest vectors of every question with text, source class, section, tags and half-filled rerank scores."""
    corpus = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = vectors.top_k(question_vectors(spark, sf), corpus, k, query_id="query_id", vector_id="vec_id")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    d, q = F.col("vec_id"), F.col("query_id")
    return near.join(docs, "vec_id").select(
        "query_id",
        F.col("vec_id").alias("doc_id"),
        "rank",
        "similarity",
        F.when(d % 2 == 0, ((d * 37 + q * 11) % 1000).cast("double") / 1000).alias("rerank_score"),
        choose(d % 4, ["vector", "web:arxiv", "neo4j", "report.pdf"]).alias("source"),
        choose(d % 5, SECTION_CYCLE).alias("section_type"),
        (d % 3 == 0).alias("has_numerical_data"),
        "content",
    )


def device_records(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as device records; the table is not unique in its key, so whole rows are made distinct first.

    Lines with their parts and suppliers are written once, shuffled once for both steps; texts and hashes are made of them
    by every query that reads the records.
    """
    li = distinct_rows(table(spark, sf, "lineitem"), by=["l_partkey"])
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    joined = li.join(part, li.l_partkey == part.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    lines = cut_lineage(
        joined.select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
            *[F.round(F.col(c) * 100).alias(c) for c in ("l_discount", "l_tax")], "l_returnflag", "l_linestatus",
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "p_name", "p_brand", "p_type", "s_name",
        )
    )
    whole = [F.col(c).cast("int") for c in ("l_quantity", "l_discount", "l_tax")]
    key = F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", whole[0], "cents", *whole[1:], "l_returnflag", "l_linestatus", "day")
    return lines.select(
        F.md5(key).alias("record_id"),
        F.concat(F.lit("10.1000/"), (F.col("l_orderkey") % 997).cast("string")).alias("doi"),
        F.col("p_name").alias("donor_name"),
        F.col("p_brand").alias("acceptor_name"),
        F.when(F.col("l_linenumber") % 3 == 0, F.col("p_type")).alias("additive_id"),
        F.when(F.col("l_linenumber") != 1, F.col("s_name")).alias("donor_smiles"),
        F.when(F.col("l_linenumber") != 2, F.col("p_type")).alias("donor_type"),
        F.col("l_quantity").alias("donor_conc"),
        F.col("l_discount").cast("double").alias("pce_percent"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("jsc_ma_cm2"),
        F.col("l_tax").cast("double").alias("voc_v"),
        F.when(F.col("l_returnflag") != "N", F.lit(0.7)).alias("ff"),
    )


def raw_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of parts in several spellings, with papers, descriptions, a property and a confidence."""
    li = distinct_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"))
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    n = F.col("l_linenumber") % 4
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.when(n == 0, F.upper("p_name"))
        .when(n == 1, F.replace("p_name", F.lit(" "), F.lit("-")))
        .when(n == 2, F.initcap("p_name"))
        .otherwise(F.col("p_name"))
        .alias("name"),
        F.when(F.col("p_partkey") % 5 == 0, "Process").otherwise("Material").alias("type"),
        F.concat(F.col("p_brand"), F.lit(" used as "), F.lower("p_type")).alias("description"),
        F.concat(F.lit("paper_"), (F.col("l_orderkey") % 211).cast("string")).alias("paper"),
        F.lit("brand").alias("prop_key"),
        F.col("p_brand").alias("prop_value"),
        ((F.col("l_quantity").cast("bigint") + 50).cast("double") / 100).alias("confidence"),
        F.concat_ws("|", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string")).alias("seq"),
    )


def raw_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier–part statements with papers, descriptions and confidences."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity").distinct()
    return li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "USES").otherwise("CONTAINS").alias("type"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_id"),
        F.concat(F.lit("flag "), F.col("l_returnflag")).alias("description"),
        F.concat(F.lit("paper_"), (F.col("l_orderkey") % 211).cast("string")).alias("paper"),
        ((F.col("l_quantity").cast("bigint") + 50).cast("double") / 100).alias("confidence"),
    )


def trade_vertices(spark: SparkSession, sf: str) -> DataFrame:
    """A typed graph over the supplied tables: nations, suppliers and parts."""
    n = table(spark, sf, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        F.lit("Nation").alias("type"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("description"),
    )
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.lit("Supplier").alias("type"), F.lit("supplier of parts").alias("description"),
    )
    p = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.lit("Part").alias("type"), F.concat(F.col("p_brand"), F.lit(" "), F.lower("p_type")).alias("description"),
    )
    return n.unionByName(s).unionByName(p)


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), F.lit("LOCATED_IN").alias("type"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("target_id"),
    )
    p = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_id"), F.lit("SUPPLIES").alias("type"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_id"),
    )
    return s.unionByName(p)


def qa_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each user turn with the assistant turn after it, labelled by conversation."""
    c = table(spark, sf, "conversations")
    ask = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    i = F.col("conv_id") + F.col("turn")
    return ask.join(reply, ["conv_id", "turn"]).select(
        F.concat(F.lit("paper_"), (F.col("conv_id")).cast("string")).alias("paper_id"),
        "conv_id",
        F.col("turn").alias("pos"),
        "question",
        "answer",
        F.when(i % 9 == 8, "stability").when(i % 9 == 7, "unknown area").otherwise(choose(i % 8, v.QA_CATEGORIES)).alias("category"),
        F.when(i % 4 == 3, "extreme").otherwise(choose(i % 4, v.DIFFICULTIES)).alias("difficulty"),
        F.when(i % 3 == 2, None).otherwise(choose(i % 3, v.REASONING_TYPES)).alias("reasoning_type"),
    )
