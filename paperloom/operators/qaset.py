"""Question–answer sets: validation, caps, identifiers, statistics, reports and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import vocab as v
from paperloom.functions.text import literal_map
from paperloom.operators.kg_query import top_per
from paperloom.session import cut_lineage


def match_category(c: Column, categories: list[str] = v.QA_CATEGORIES) -> Column:
    """The category itself, else the first known one that contains it or is contained in it, else NULL.

    The list of categories is fixed, so the comparison is one expression and no join.
    """
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for name in reversed(categories):
        near = low.contains(name.lower()) | F.lit(name.lower()).contains(low)
        out = F.when(near, name).otherwise(out)
    return F.when(c.isin(categories), c).otherwise(out)


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(default)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def valid_points(points: DataFrame) -> DataFrame:
    """Knowledge points with content and a category that can be matched; unknown complexities become single-hop."""
    fixed = points.filter(_filled("content") & _filled("category")).withColumns(
        {"category": match_category(F.col("category")), "complexity": one_of(F.col("complexity"), v.REASONING_TYPES, "single-hop")}
    )
    return fixed.filter(F.col("category").isNotNull())


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with question and answer; labels that are unknown fall back to the first category, medium, single-hop."""
    category = F.coalesce(match_category(F.coalesce("category", F.lit(""))), F.lit(v.QA_CATEGORIES[0]))
    return pairs.filter(_filled("question") & _filled("answer")).withColumns(
        {
            "category": category,
            "difficulty": one_of(F.col("difficulty"), v.DIFFICULTIES, "medium"),
            "reasoning_type": one_of(F.col("reasoning_type"), v.REASONING_TYPES, "single-hop"),
        }
    )


def cap_per_paper(pairs: DataFrame, limit: int, paper: str = "paper_id", order: str = "pos") -> DataFrame:
    """At most ``limit`` pairs of every paper, in order."""
    return top_per(pairs, [paper], [order], limit, "_r").drop("_r")


def cross_document_sample(points: DataFrame, papers: int, per_paper: int = 50, seed: int = 0, paper: str = "paper_id", order: str = "pos") -> DataFrame:
    """Points of a seeded sample of papers, labelled as hard cross-document material; empty with fewer than two papers."""
    ids = points.select(paper).distinct()
    chosen = ids.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(paper))), paper).limit(papers)
    enough = Window.partitionBy()
    chosen = chosen.withColumn("_n", F.count("*").over(enough)).filter("_n >= 2").drop("_n")
    kept = top_per(points.join(chosen, paper, "left_semi"), [paper], [order], per_paper, "point_no")
    return kept.withColumns({"difficulty": F.lit("hard"), "reasoning_type": F.lit("cross-doc")})


def joined_titles(sample: DataFrame, title: str = "paper_id") -> DataFrame:
    """The titles of a sample as one text."""
    return sample.select(title).distinct().agg(F.array_join(F.array_sort(F.collect_list(title)), " | ").alias("source_title"))


def number_rows(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """Consecutive numbers from 1 in a global order, without one task that sees all rows.

    Rows are range-partitioned by the order and written, each partition is counted, and a partition's rows are
    numbered from the sum of the counts before it.
    """
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition, so this window is tiny
    offsets = placed.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(offsets, "_p").withColumn(name, F.col("_before") + within).drop("_p", "_before")


def export_ids(pairs: DataFrame, order: list[str]) -> DataFrame:
    """``qa_0001`` and on, in paper order."""
    n = number_rows(pairs, order, "_n")
    return n.withColumn("id", F.format_string("qa_%04d", F.col("_n"))).drop("_n")


def statistics(pairs: DataFrame, paper: str = "paper_id") -> DataFrame:
    """One row: pairs, papers and pairs per paper."""
    per = pairs.groupBy(paper).agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("total_qa_pairs"), F.count("*").alias("total_papers"), F.bround(F.avg("n"), 6).alias("avg_qa_per_paper"), F.min("n").alias("min_qa_per_paper"), F.max("n").alias("max_qa_per_paper")
    )


def distributions(pairs: DataFrame) -> DataFrame:
    """Counts and shares in percent of category, difficulty and reasoning type, from one pass."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in ("category", "difficulty", "reasoning_type")])
    counts = pairs.select(F.explode(dims).alias("d")).groupBy("d.dimension", "d.label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.bround(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("dimension")), 6))


def per_paper(pairs: DataFrame, paper: str = "paper_id", label: str = "category", shown: int = 2) -> DataFrame:
    """Pairs of every paper with its most frequent categories."""
    counts = pairs.groupBy(paper, label).agg(F.count("*").alias("n"))
    total = counts.groupBy(paper).agg(F.sum("n").alias("pairs"))
    top = top_per(counts, [paper], [F.desc("n"), label], shown).groupBy(paper).agg(F.array_sort(F.collect_list(F.struct("rank", label))).alias("_t"))
    return total.join(top, paper).select(paper, "pairs", F.array_join(F.transform("_t", lambda x: x[label]), ", ").alias("top_categories"))


def file_status(files: DataFrame, items: str) -> DataFrame:
    """Is a scanned file good, errored, empty or unreadable?"""
    error = F.col("token_usage.error")
    status = (
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(error.isNotNull(), "errored")
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, "empty").otherwise("ok")
    )
    return files.withColumn("status", status)


def status_counts(checked: DataFrame, items: str) -> DataFrame:
    """Files and items per status."""
    n = F.when(F.col("status") == "ok", F.size(items)).otherwise(0)
    return checked.groupBy("status").agg(F.count("*").alias("files"), F.sum(n).alias("items"))


def stages(everything: DataFrame, checked: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, stage, <stage>_status, ...): every item at its furthest stage.

    ``checked`` holds, in the order of the stages, tables (key, status).  They meet by full outer joins, so an item that
    only a later stage knows is located as well; an item of no stage is ``waiting``, and the stage behind the furthest good
    one is where it ``failed`` or is ``open``.
    """
    out = everything.select(key).distinct()
    for name, files in checked.items():
        # the best file counts where an item has several
        best = files.groupBy(key).agg(F.min_by("status", F.when(F.col("status") == "ok", 0).otherwise(1)).alias(f"{name}_status"))
        out = out.join(best, key, "full_outer")
    furthest = F.lit("waiting")
    for name in checked:
        furthest = F.when(F.col(f"{name}_status") == "ok", name).otherwise(furthest)
    return out.withColumn("stage", furthest)


def stage_counts(located: DataFrame, names: list[str]) -> DataFrame:
    """(stage, items, done, failed, open): how many items stand at a stage, and per stage how many passed it, failed at it or have no file of it."""
    total = located.agg(*[f.alias(f"{n}_{k}") for n in names for k, f in (
        ("items", F.count_if(F.col("stage") == n)), ("done", F.count_if(F.col(f"{n}_status") == "ok")),
        ("failed", F.count_if(F.col(f"{n}_status") != "ok")), ("open", F.count_if(F.col(f"{n}_status").isNull())),
    )], F.count_if(F.col("stage") == "waiting").alias("waiting_items"))
    rows = [F.struct(F.lit(n).alias("stage"), *[F.col(f"{n}_{k}").alias(k) for k in ("items", "done", "failed", "open")]) for n in names]
    none = F.lit(None).cast("bigint")
    rows.append(F.struct(F.lit("waiting").alias("stage"), F.col("waiting_items").alias("items"), none.alias("done"), none.alias("failed"), none.alias("open")))
    return total.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_categories(pairs: DataFrame, categories: list[str] = v.QA_CATEGORIES) -> DataFrame:
    expected = pairs.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return expected.join(pairs.select("category").distinct(), "category", "left_anti")


def unprocessed(everything: DataFrame, checked: DataFrame, key: str) -> DataFrame:
    """What is still to do: not processed, or processed with an error or without a result."""
    done = checked.filter(F.col("status") == "ok").select(key).distinct()
    return everything.join(done, key, "left_anti")


def token_usage(usage: DataFrame, by: list[str] | None = None, input_price: float = 0.01, output_price: float = 0.03) -> DataFrame:
    """Requests, tokens, tokens per minute between first and last request, and cost at prices per 1,000 tokens."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    minutes = (F.max(micros) - F.min(micros)) / 60_000_000
    total = F.sum(F.col("prompt_tokens") + F.col("completion_tokens"))
    return usage.groupBy(*(by or [])).agg(
        F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), total.alias("total_tokens"),
        F.when(minutes > 0, total / minutes).otherwise(0.0).alias("tokens_per_minute"),
        (F.sum("prompt_tokens") / 1000 * input_price + F.sum("completion_tokens") / 1000 * output_price).alias("estimated_cost_usd"),
    )
