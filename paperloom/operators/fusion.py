"""Evidence for a table of questions: rerank, filter, deduplicate, merge by source, lay out, cite.

A context table has one row per (query_id, rank) with content, source and optional scores; absence of a score is NULL.
Windows run per question over the few contexts that retrieval returned for it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import vocab as v
from paperloom.functions.questions import question_type
from paperloom.functions.text import close_formula_percent, has_any, literal_map, strip
from paperloom.operators.kg_query import top_per
from paperloom.operators.components import connected
from paperloom.session import Steps

Q = "query_id"


def _w(*order) -> Window:
    return Window.partitionBy(Q).orderBy(*order)


def score(default: float | None = 0.0) -> Column:
    """Rerank score, else similarity, else the default."""
    return F.coalesce("rerank_score", "similarity", F.lit(default).cast("double"))


# --- ranking -------------------------------------------------------------------------------------------------------
def apply_rerank(contexts: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """Keep the best contexts by an (index, score) list per question; indexes beyond the contexts fall out."""
    joined = contexts.drop("rerank_score").join(scores, (contexts[Q] == scores[Q]) & (contexts["rank"] - 1 == scores["index"])).drop(scores[Q])
    return top_per(joined, [Q], [F.desc("score"), "rank"], top_n, "new_rank").withColumnRenamed("score", "rerank_score").drop("index")


def order_fallback(contexts: DataFrame) -> DataFrame:
    """Scores when the reranker failed: they keep the order and fall by 0.1."""
    return contexts.withColumn("rerank_score", F.bround(1.0 - (F.col("rank") - 1) * 0.1, 6))


def parsed_rerank_scores(contexts: DataFrame, raw: str = "raw_score") -> DataFrame:
    """Scores read from an answer: scaled by their maximum when above 1; 0.6 falling by 0.05, then 0.4, when missing."""
    top = F.max(raw).over(Window.partitionBy(Q))
    missing = F.count_if(F.col(raw).isNull()).over(Window.partitionBy(Q)) > 0
    i = F.col("rank") - 1
    fallback = F.when(i < 10, 0.6 - i * 0.05).otherwise(0.4)
    scaled = F.when(top > 1, F.col(raw) / top).otherwise(F.col(raw))
    return contexts.withColumn("rerank_score", F.bround(F.when(missing, fallback).otherwise(scaled), 6))


def compare_rankings(contexts: DataFrame, k: int = 5) -> DataFrame:
    """The first k by similarity next to the first k by rerank score, and whether a rank holds the same document."""
    a = top_per(contexts.select(Q, "doc_id", "similarity", F.col("rank").alias("_o")), [Q], [F.desc("similarity"), "_o"], k)
    b = top_per(
        contexts.filter(F.col("rerank_score").isNotNull()).select(Q, "doc_id", "rerank_score", F.col("rank").alias("_o")), [Q],
        [F.desc("rerank_score"), "_o"], k,
    )
    left = a.select(Q, "rank", F.col("doc_id").alias("by_similarity"), "similarity")
    right = b.select(Q, "rank", F.col("doc_id").alias("by_rerank"), "rerank_score")
    both = left.join(right, [Q, "rank"], "full_outer")
    return both.withColumn("same", F.coalesce(F.col("by_similarity") == F.col("by_rerank"), F.lit(False)))


def rerank_numeric(contexts: DataFrame, questions: DataFrame, question: str = "question", keep: int = 5) -> DataFrame:
    """Questions about numbers keep their five best reranked contexts, others keep all."""
    typed = contexts.join(questions.select(Q, (question_type(F.col(question)) == "numerical").alias("_numeric")), Q)
    ranked = typed.withColumn("_r", F.row_number().over(_w(F.desc_nulls_last("rerank_score"), "rank")))
    return ranked.filter(~F.col("_numeric") | ((F.col("_r") <= keep) & F.col("rerank_score").isNotNull())).select(
        *contexts.columns, F.when(F.col("_numeric"), F.col("_r")).otherwise(F.col("rank")).alias("new_rank")
    )


# --- filters and merging ---------------------------------------------------------------------------------------------
def relevant(
    contexts: DataFrame, question: Column | None = None, priority_sections: Column | None = None, unscored: str = "drop",
    threshold: float = v.MIN_SIMILARITY, relaxed: float = v.MIN_SIMILARITY_RELAXED,
) -> DataFrame:
    """Contexts similar enough; preferred sections and numeric passages for numeric questions pass a lower bar.

    Unscored contexts count as 0 and fall out (``drop``) unless they are to be kept (``keep``).
    """
    value = F.coalesce("similarity", "rerank_score", F.lit(0.0))
    lower = F.lit(False)
    if priority_sections is not None:
        lower = lower | F.array_contains(priority_sections, F.col("section_type"))
    if question is not None:
        lower = lower | (has_any(question, v.NUMERIC_QUERY_WORDS) & F.col("has_numerical_data"))
    ok = value >= F.when(F.coalesce(lower, F.lit(False)), relaxed).otherwise(threshold)
    if unscored == "keep":
        ok = ok | (F.col("similarity").isNull() & F.col("rerank_score").isNull())
    return contexts.filter(ok)


def prefix_key(content: Column, chars: int | None) -> Column:
    return strip(content if chars is None else F.left(content, F.lit(chars)))


def drop_near_copies(contexts: DataFrame, keys: list[str], order: list, chars: int | None = 200) -> DataFrame:
    """The first of all contexts whose first 200 characters agree; contexts without text fall out.

    Contexts are retrieved passages.  For whole documents use ``chars=None``: only equal texts are copies then.

    The key is a 16-byte hash, and every task trims each key to one row before the shuffle, so text that a third of all
    rows share moves one row per task.
    """
    keyed = contexts.withColumn("_key", F.md5(prefix_key(F.col("content"), chars))).filter(F.length(prefix_key(F.col("content"), chars)) > 0)
    return top_per(keyed, keys + ["_key"], order, 1, "_one").drop("_one", "_key")


def merge_sources(contexts: DataFrame, limit: int = v.MAX_CONTEXTS, web_limit: int = v.MAX_WEB_CONTEXTS) -> DataFrame:
    """Best contexts by score with slots reserved for the web: up to ten web contexts, the others fill the rest."""
    web = F.col("source").startswith("web")
    ranked = contexts.withColumn("_web", web).withColumn(
        "_r", F.row_number().over(Window.partitionBy(Q, "_web").orderBy(F.desc(score()), "rank"))
    )
    slots = F.least(F.count_if("_web").over(Window.partitionBy(Q)), F.lit(web_limit))
    kept = ranked.withColumn("_slots", slots).filter(F.col("_r") <= F.when(F.col("_web"), F.col("_slots")).otherwise(limit - F.col("_slots")))
    return kept.withColumn("final_rank", F.row_number().over(_w("_web", "_r"))).drop("_web", "_r", "_slots")


def context_stats(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy(Q).agg(
        F.count("*").alias("total_contexts"),
        F.count_distinct("source").alias("unique_sources"),
        F.count_if(F.col("similarity").isNotNull() | F.col("rerank_score").isNotNull()).alias("has_scores"),
        *[F.count_if(source_class() == c).alias(f"{c}_contexts") for c in ("vector", "kg", "web", "other")],
    )


# --- layout ------------------------------------------------------------------------------------------------------------
def budgeted_text(contexts: DataFrame, order: str = "rank", max_chars: int = v.CONTEXT_BUDGET, include_sources: bool = True) -> DataFrame:
    """Numbered contexts joined until the first one that would exceed the budget; a note marks the cut."""
    n = F.row_number().over(_w(order))
    shown = F.coalesce("similarity", "rerank_score", F.lit(0.0))
    head = F.concat(F.lit("[Context "), n.cast("string"), F.lit("]"))
    if include_sources:
        head = F.concat(head, F.lit(" (Source: "), F.col("source"), F.lit(", Score: "), F.format_string("%.2f", shown), F.lit(")"))
    entries = contexts.select(Q, n.alias("n"), F.concat(head, F.lit("\n"), F.col("content"), F.lit("\n")).alias("entry"))
    running = F.sum(F.length("entry")).over(_w("n").rowsBetween(Window.unboundedPreceding, 0))
    fits = entries.withColumn("_fits", running <= max_chars)
    grouped = fits.groupBy(Q).agg(
        F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("n", "entry")))).alias("e"),
        F.count_if(~F.col("_fits")).alias("left_out"),
    )
    parts = F.concat(F.transform("e", lambda x: x["entry"]), F.when(F.col("left_out") > 0, F.array(F.lit(v.TRUNCATION_NOTE))).otherwise(F.array().cast("array<string>")))
    return grouped.select(Q, F.size("e").alias("used"), "left_out", F.array_join(parts, "\n").alias("context_text"))


def primary_layout(contexts: DataFrame, facts: DataFrame | None = None, shown: int = 5) -> DataFrame:
    """The first documents in full, then graph facts (query_id, fact) as supplementary text."""
    first = top_per(contexts, [Q], ["rank"], shown, "_n")
    block = F.concat(F.lit("[Document "), F.col("_n").cast("string"), F.lit("] (Source: "), F.col("source"), F.lit(")\n"), close_formula_percent(F.col("content")), F.lit("\n"))
    docs = first.groupBy(Q).agg(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: x["b"]), "\n")
    if facts is None:
        return docs.select(Q, text.alias("layout"))
    joined = docs.join(facts, Q, "left")
    extra = F.when(F.coalesce("fact", F.lit("")) != "", F.concat(F.lit("=== SUPPLEMENTARY ===\n"), F.col("fact")))
    return joined.select(Q, F.concat_ws("\n", text, extra).alias("layout"))


def source_class(c: str = "source") -> Column:
    s = F.col(c)
    low = F.lower(s)
    return (
        F.when(low.contains("vector") | s.contains(".pdf") | s.contains(".md"), "vector")
        .when(low.contains("kg") | low.contains("neo4j"), "kg").when(low.contains("web"), "web").otherwise("other")
    )


def citations(contexts: DataFrame) -> DataFrame:
    """Sorted source names and a line such as ``[Sources: 5 vector docs + 3 KG entities]`` per question."""
    labels = [("vector", "vector docs"), ("kg", "KG entities"), ("web", "web results"), ("other", "other sources")]
    counts = {c: F.count_if(source_class() == c) for c, _ in labels}
    named = [F.when(counts[c] > 0, F.concat(counts[c].cast("string"), F.lit(" " + label))) for c, label in labels]
    sources = F.array_join(F.array_sort(F.collect_set("source")), "|")
    return contexts.groupBy(Q).agg(sources.alias("sources"), F.concat(F.lit("[Sources: "), F.concat_ws(" + ", *named), F.lit("]")).alias("citation"))


# --- results of several providers ----------------------------------------------------------------------------------------
def drop_shared_identifiers(
    results: DataFrame, row: str, identifiers: str, group: list[str], order: list[str], rounds: int = 3, most_rows: int = 200_000
) -> DataFrame:
    """Keep a result unless an earlier *kept* result of its group shares one of its identifiers.

    A round keeps the rows that come first for all of their identifiers among the rows still open and drops the open rows
    that share one with a kept row.  Popular identifiers are settled so, but a chain, where each result shares one
    identifier with the next, would take as many rounds as it is long.  So after ``rounds`` rounds the rest is split into the connected
    components of its conflicts, and every component of up to ``most_rows`` rows is finished by the sequential rule in a
    task of its own.  A greater component goes on by rounds.  Results without identifiers fall out.
    """
    steps = Steps(results.sparkSession)
    key = F.struct(*order, *([] if row in order else [row]))
    node = F.xxhash64(*group, row)
    ids = results.select(*group, row, key.alias("_o"), node.alias("_n"), F.explode_outer(F.array_distinct(identifiers)).alias("_id")).filter(F.col("_id").isNotNull())
    open_ids, kept, done = steps.cut(ids), [], 0
    while not open_ids.isEmpty():
        if done and done % rounds == 0:
            settled, open_ids = _finish_small(steps, open_ids, row, group, most_rows)
            kept.append(settled)
        else:
            winners, open_ids = _round(steps, open_ids, row, group)
            kept.append(winners)
        done += 1
    if not kept:
        return results.filter(F.lit(False))
    every = kept[0]
    for k in kept[1:]:
        every = every.unionByName(k)
    return results.join(steps.keep(every), [*group, row], "left_semi")


def _round(steps: Steps, open_ids: DataFrame, row: str, group: list[str]) -> tuple[DataFrame, DataFrame]:
    first = open_ids.groupBy(*group, "_id").agg(F.min("_o").alias("_first"))
    judged = open_ids.join(first, [*group, "_id"])
    winners = judged.groupBy(*group, row).agg(F.bool_and(F.col("_o") == F.col("_first")).alias("_wins")).filter("_wins").drop("_wins")
    winners = steps.cut(winners)
    taken = open_ids.join(winners, [*group, row], "left_semi").select(*group, "_id").distinct()
    losers = open_ids.join(taken, [*group, "_id"], "left_semi").select(*group, row).distinct()
    return winners, steps.cut(open_ids.join(losers, [*group, row], "left_anti"))


def _finish_small(steps: Steps, open_ids: DataFrame, row: str, group: list[str], most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows of the small components, open rows of the others).

    Rows are joined with the first row of each of their identifiers, so a popular identifier is a star and no clique.
    Equal hashes of two rows only join their components, which changes no decision.
    """
    centre = open_ids.groupBy(*group, "_id").agg(F.min("_n").alias("_to"))
    links = open_ids.join(centre, [*group, "_id"]).select("_n", "_to")
    roots = connected(links).toDF("_n", "_root")
    parts = steps.cut(open_ids.join(roots, "_n", "left").withColumn("_root", F.coalesce("_root", "_n")))
    small = parts.groupBy("_root").agg(F.count("*").alias("_rows")).filter(F.col("_rows") <= most_rows).select("_root")
    columns = [*group, row]
    schema = T.StructType([parts.schema[c] for c in columns])

    def sequential(pdf: pd.DataFrame) -> pd.DataFrame:
        return _kept_in_order(pdf, columns, len(group))

    settled = parts.join(small, "_root", "left_semi").groupBy("_root").applyInPandas(sequential, schema)
    rest = parts.join(small, "_root", "left_anti").drop("_root")
    return steps.cut(settled), steps.cut(rest.select(*open_ids.columns))


def _kept_in_order(pdf: pd.DataFrame, columns: list[str], n_group: int) -> pd.DataFrame:
    """The sequential rule over the rows (columns, _o, _id) of one component; the first ``n_group`` columns are the group."""
    plain = [[None if x is None or x != x else x for x in pdf[c].tolist()] for c in columns]
    order = [tuple(o.values()) if isinstance(o, dict) else tuple(o) for o in pdf["_o"]]
    found: dict[tuple, set] = {}
    for key, result, i in zip(order, zip(*plain), pdf["_id"].tolist()):
        found.setdefault((key, result), set()).add((*result[:n_group], i))
    seen, out = set(), []
    for (_, result), ids in sorted(found.items(), key=lambda x: x[0][0]):
        if seen.isdisjoint(ids):
            seen |= ids
            out.append(result)
    return pd.DataFrame(out, columns=columns)


def drop_repeated_urls(results: DataFrame, group: list[str], order: list[str], url: str = "url", title: str = "title") -> DataFrame:
    """The first result per url, or per title where there is no url."""
    key = F.coalesce(F.nullif(strip(F.col(url)), F.lit("")), F.col(title))
    keyed = results.withColumn("_key", key).filter(F.coalesce(F.col("_key"), F.lit("")) != "")
    return top_per(keyed, group + ["_key"], order, 1, "_one").drop("_one", "_key")


def allocate(results: DataFrame, providers: list[str], k: int, order: list[str]) -> DataFrame:
    """An equal share per provider (at least one), providers in the given order, k in all."""
    share = max(1, k // len(providers))
    place = literal_map((p, i) for i, p in enumerate(providers))
    ranked = top_per(results.withColumn("_p", F.try_element_at(place, F.col("source"))).filter(F.col("_p").isNotNull()), [Q, "_p"], order, share, "_r")
    return top_per(ranked, [Q], ["_p", "_r"], k, "merged_rank").drop("_p", "_r")


def provider_score(source: Column, rank: Column) -> Column:
    """Base score of the provider, two points less per rank, within 0.35..0.95."""
    base = F.coalesce(F.try_element_at(literal_map(v.PROVIDER_BASE_SCORES.items()), source), F.lit(v.PROVIDER_DEFAULT_SCORE))
    return F.bround(F.greatest(F.lit(0.35), F.least(F.lit(0.95), base.cast("double") - rank * 0.02)), 6)


def result_text(title: Column, abstract: Column, authors: Column, published: Column, url: Column) -> Column:
    def line(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    return F.concat_ws("\n", line("", title), line("Summary: ", abstract), line("Authors: ", authors), line("Published: ", published), line("URL: ", url))


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the second provider only for questions the first one left empty."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
